"""The entry: one located piece of text of a file."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_ord", T.LongType(), False),
        T.StructField("entry_ord", T.IntegerType(), False),
        T.StructField("line_number", T.IntegerType(), False),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("cell_address", T.StringType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("content", T.StringType(), False),
    ]
)

#: Texts of labels by key; other languages replace the table.
LABELS = {
    "comment": "Comment",
    "shape": "Shape",
    "header": "Header",
    "footer": "Footer",
    "header_footer": "Header/Footer",
    "properties": "Document Properties",
    "hyperlink": "Hyperlink",
    "alt_text": "Alt Text",
    "table_chart": "Table/Chart",
    "smart_art": "SmartArt",
    "slide": "Slide",
    "slide_master": "Slide Master",
    "slide_layout": "Slide Layout",
    "note": "Note",
    "document_info": "DocumentInfo",
    "page": "Page",
    "bookmark": "Bookmark",
    "form_field": "Form Field",
    "row": "Row",
    "object": "Object",
}

#: The same labels in Japanese.
LABELS_JA = {
    "comment": "コメント",
    "shape": "図形",
    "header": "ヘッダー",
    "footer": "フッター",
    "header_footer": "ヘッダー/フッター",
    "properties": "文書プロパティ",
    "hyperlink": "ハイパーリンク",
    "alt_text": "代替テキスト",
    "table_chart": "表/グラフ",
    "smart_art": "SmartArt",
    "slide": "スライド",
    "slide_master": "スライドマスター",
    "slide_layout": "スライドレイアウト",
    "note": "ノート",
    "document_info": "文章情報",
    "page": "ページ",
    "bookmark": "しおり",
    "form_field": "フォーム",
    "row": "行",
    "object": "オブジェクト",
}
