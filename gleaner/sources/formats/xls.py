"""Workbooks of the binary format (BIFF8)."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

from .base import Options, Piece, blank, new_lines
from .cfb import CompoundFile
from .xlsx import date_text, is_date_format

EXTENSIONS = (".xls",)
#: Record types.
FORMULA, CONTINUE, STRING, BOUNDSHEET, SST, LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, XF, FORMAT, NOTE, TXO, OBJ, DATEMODE, RSTRING, SHRFMLA = (
    0x06, 0x3C, 0x207, 0x85, 0xFC, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0xE0, 0x41E, 0x1C, 0x1B6, 0x5D, 0x22, 0xD6, 0x4BC,
)
#: Error codes.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Binary operators by token.
OPERATORS = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
#: Name and number of arguments (None: given in the formula) of functions by number.
FUNCTIONS = {
    0: ("COUNT", None), 1: ("IF", None), 2: ("ISNA", 1), 3: ("ISERROR", 1), 4: ("SUM", None), 5: ("AVERAGE", None), 6: ("MIN", None), 7: ("MAX", None), 8: ("ROW", None), 9: ("COLUMN", None),
    10: ("NA", 0), 11: ("NPV", None), 12: ("STDEV", None), 13: ("DOLLAR", None), 14: ("FIXED", None), 15: ("SIN", 1), 16: ("COS", 1), 17: ("TAN", 1), 19: ("PI", 0), 20: ("SQRT", 1),
    21: ("EXP", 1), 22: ("LN", 1), 23: ("LOG10", 1), 24: ("ABS", 1), 25: ("INT", 1), 26: ("SIGN", 1), 27: ("ROUND", 2), 28: ("LOOKUP", None), 29: ("INDEX", None), 30: ("REPT", 2), 31: ("MID", 3),
    32: ("LEN", 1), 33: ("VALUE", 1), 34: ("TRUE", 0), 35: ("FALSE", 0), 36: ("AND", None), 37: ("OR", None), 38: ("NOT", 1), 39: ("MOD", 2), 40: ("DCOUNT", 3), 41: ("DSUM", 3),
    42: ("DAVERAGE", 3), 43: ("DMIN", 3), 44: ("DMAX", 3), 46: ("VAR", None), 47: ("DVAR", 3), 48: ("TEXT", 2), 49: ("LINEST", None), 50: ("TREND", None), 51: ("LOGEST", None),
    52: ("GROWTH", None), 56: ("PV", None), 57: ("FV", None), 58: ("NPER", None), 59: ("PMT", None), 60: ("RATE", None), 61: ("MIRR", 3), 62: ("IRR", None), 63: ("RAND", 0), 64: ("MATCH", None),
    65: ("DATE", 3), 66: ("TIME", 3), 67: ("DAY", 1), 68: ("MONTH", 1), 69: ("YEAR", 1), 70: ("WEEKDAY", None), 71: ("HOUR", 1), 72: ("MINUTE", 1), 73: ("SECOND", 1), 74: ("NOW", 0),
    75: ("AREAS", 1), 76: ("ROWS", 1), 77: ("COLUMNS", 1), 78: ("OFFSET", None), 82: ("SEARCH", None), 83: ("TRANSPOSE", 1), 86: ("TYPE", 1), 97: ("ATAN2", 2), 98: ("ASIN", 1), 99: ("ACOS", 1),
    100: ("CHOOSE", None), 101: ("HLOOKUP", None), 102: ("VLOOKUP", None), 105: ("ISREF", 1), 109: ("LOG", None), 111: ("CHAR", 1), 112: ("LOWER", 1), 113: ("UPPER", 1), 114: ("PROPER", 1),
    115: ("LEFT", None), 116: ("RIGHT", None), 117: ("EXACT", 2), 118: ("TRIM", 1), 119: ("REPLACE", 4), 120: ("SUBSTITUTE", None), 121: ("CODE", 1), 124: ("FIND", None), 125: ("CELL", None),
    126: ("ISERR", 1), 127: ("ISTEXT", 1), 128: ("ISNUMBER", 1), 129: ("ISBLANK", 1), 130: ("T", 1), 131: ("N", 1), 140: ("DATEVALUE", 1), 141: ("TIMEVALUE", 1), 142: ("SLN", 3), 143: ("SYD", 4),
    144: ("DDB", None), 148: ("INDIRECT", None), 162: ("CLEAN", 1), 163: ("MDETERM", 1), 164: ("MINVERSE", 1), 165: ("MMULT", 2), 167: ("IPMT", None), 168: ("PPMT", None), 169: ("COUNTA", None),
    183: ("PRODUCT", None), 184: ("FACT", 1), 189: ("DPRODUCT", 3), 190: ("ISNONTEXT", 1), 193: ("STDEVP", None), 194: ("VARP", None), 197: ("TRUNC", None), 198: ("ISLOGICAL", 1),
    199: ("DCOUNTA", 3), 212: ("ROUNDUP", 2), 213: ("ROUNDDOWN", 2), 216: ("RANK", None), 219: ("ADDRESS", None), 220: ("DAYS360", None), 221: ("TODAY", 0), 222: ("VDB", None),
    227: ("MEDIAN", None), 228: ("SUMPRODUCT", None), 229: ("SINH", 1), 230: ("COSH", 1), 231: ("TANH", 1), 232: ("ASINH", 1), 233: ("ACOSH", 1), 234: ("ATANH", 1), 235: ("DGET", 3),
    244: ("INFO", 1), 247: ("DB", None), 252: ("FREQUENCY", 2), 261: ("ERROR.TYPE", 1), 269: ("AVEDEV", None), 273: ("BINOMDIST", 4), 276: ("COMBIN", 2), 277: ("CONFIDENCE", 3), 279: ("EVEN", 1),
    285: ("FLOOR", 2), 288: ("CEILING", 2), 293: ("NORMDIST", 4), 294: ("NORMSDIST", 1), 295: ("NORMINV", 3), 296: ("NORMSINV", 1), 297: ("STANDARDIZE", 3), 298: ("ODD", 1), 299: ("PERMUT", 2),
    303: ("SUMXMY2", 2), 304: ("SUMX2MY2", 2), 305: ("SUMX2PY2", 2), 307: ("CORREL", 2), 308: ("COVAR", 2), 309: ("FORECAST", 3), 311: ("INTERCEPT", 2), 312: ("PEARSON", 2), 313: ("RSQ", 2),
    314: ("STEYX", 2), 315: ("SLOPE", 2), 316: ("TTEST", 4), 317: ("PROB", None), 318: ("DEVSQ", None), 319: ("GEOMEAN", None), 320: ("HARMEAN", None), 321: ("SUMSQ", None), 322: ("KURT", None),
    323: ("SKEW", None), 325: ("LARGE", 2), 326: ("SMALL", 2), 327: ("QUARTILE", 2), 328: ("PERCENTILE", 2), 329: ("PERCENTRANK", None), 330: ("MODE", None), 331: ("TRIMMEAN", 2),
    336: ("CONCATENATE", None), 337: ("POWER", 2), 342: ("RADIANS", 1), 343: ("DEGREES", 1), 344: ("SUBTOTAL", None), 345: ("SUMIF", None), 346: ("COUNTIF", 2), 347: ("COUNTBLANK", 1),
    351: ("DATEDIF", 3), 354: ("ROMAN", None), 359: ("HYPERLINK", None), 361: ("AVERAGEA", None), 362: ("MAXA", None), 363: ("MINA", None),
}


@lru_cache(256)
def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def address(row: int, column: int) -> str:
    return f"{column_name(column)}{row + 1}"


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def rk(value: int) -> float:
    """A number of 30 bits: an integer or the upper part of a double, perhaps in hundredths."""
    if value & 2:
        x = float((value >> 2) - (1 << 30) if value & 0x80000000 else value >> 2)
    else:
        x = struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return x / 100 if value & 1 else x


_STRING_HEAD, _HEAD, _CELL = struct.Struct("<HB").unpack_from, struct.Struct("<HH").unpack_from, struct.Struct("<HHH").unpack_from


class _Strings:
    """Reads strings that may go over the border of records, where a new byte tells the width of characters."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def _left(self) -> int:
        return len(self.parts[self.k]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        if self._left() == 0 and self.k + 1 < len(self.parts):
            self.k, self.at = self.k + 1, 0
        part, at = self.parts[self.k], self.at
        if at + 3 <= len(part):  # nearly all are plain and whole in their record
            n, flags = _STRING_HEAD(part, at)
            end = at + 3 + (2 * n if flags & 1 else n)
            if not flags & 12 and end <= len(part):
                self.at = end
                return part[at + 3 : end].decode("utf-16-le" if flags & 1 else "latin-1", "replace")
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self._left() == 0:
                if self.k + 1 >= len(self.parts):
                    break
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            m = min(n, self._left() // (2 if wide else 1))
            if m == 0:
                break
            out += self.take(m * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= m
        self.take(4 * runs + extra)
        return out


def short_string(data: bytes, size: int) -> str:
    """A string with a length of `size` bytes and a byte for the width of characters."""
    n = int.from_bytes(data[:size], "little")
    wide = data[size] & 1
    return data[size + 1 : size + 1 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def formula_text(tokens: bytes, row: int = 0, column: int = 0) -> str:
    """The formula of a token string; unknown tokens show as #?."""
    stack: list[str] = []
    at = 0

    def ref(r: int, c: int) -> str:
        return ("" if c & 0x4000 else "$") + column_name(c & 0xFF) + ("" if c & 0x8000 else "$") + str(r + 1)

    def call(name: str, n: int) -> None:
        args = stack[len(stack) - n :] if n else []
        del stack[len(stack) - n :]
        stack.append(f"{name}({','.join(args)})")

    while at < len(tokens):
        t = tokens[at]
        base = t if t < 0x20 else 0x20 | (t & 0x1F)
        at += 1
        if t in OPERATORS and len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            stack.append(a + OPERATORS[t] + b)
        elif t in (0x12, 0x13) and stack:
            stack.append("+-"[t - 0x12] + stack.pop())
        elif t == 0x14 and stack:
            stack.append(stack.pop() + "%")
        elif t == 0x15 and stack:
            stack.append(f"({stack.pop()})")
        elif t == 0x16:
            stack.append("")
        elif t == 0x17:
            text = short_string(tokens[at:], 1)
            stack.append('"' + text.replace('"', '""') + '"')
            at += 2 + len(text) * (2 if tokens[at + 1] & 1 else 1)
        elif t == 0x19:
            kind, n = struct.unpack_from("<BH", tokens, at)
            at += 3
            if kind & 0x04:
                at += 2 * (n + 1)
            elif kind & 0x10:
                call("SUM", 1)
        elif t == 0x1C:
            stack.append(ERRORS.get(tokens[at], "#?"))
            at += 1
        elif t == 0x1D:
            stack.append("TRUE" if tokens[at] else "FALSE")
            at += 1
        elif t == 0x1E:
            stack.append(str(struct.unpack_from("<H", tokens, at)[0]))
            at += 2
        elif t == 0x1F:
            stack.append(number_text(struct.unpack_from("<d", tokens, at)[0]))
            at += 8
        elif base == 0x21:
            n = struct.unpack_from("<H", tokens, at)[0]
            at += 2
            name, args = FUNCTIONS.get(n, (f"FUNC{n}", 1))
            call(name, min(len(stack), args if args is not None else 1))
        elif base == 0x22:
            args, n = struct.unpack_from("<BH", tokens, at)
            at += 3
            call(FUNCTIONS.get(n & 0x7FFF, (f"FUNC{n & 0x7FFF}", None))[0], min(len(stack), args & 0x7F))
        elif base == 0x24:
            stack.append(ref(*struct.unpack_from("<HH", tokens, at)))
            at += 4
        elif base == 0x25:
            r1, r2, c1, c2 = struct.unpack_from("<HHHH", tokens, at)
            stack.append(f"{ref(r1, c1)}:{ref(r2, c2)}")
            at += 8
        elif base == 0x23:
            stack.append(f"NAME{struct.unpack_from('<H', tokens, at)[0]}")
            at += 4
        elif base == 0x3A:
            _, r, c = struct.unpack_from("<HHH", tokens, at)
            stack.append(ref(r, c))
            at += 6
        elif base == 0x3B:
            _, r1, r2, c1, c2 = struct.unpack_from("<HHHHH", tokens, at)
            stack.append(f"{ref(r1, c1)}:{ref(r2, c2)}")
            at += 10
        else:
            stack.append("#?")
            break
    return "".join(stack)


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, list[bytes]]]:
    """(offset, type, [data and its continuations]) of the records from `at` on."""
    last = len(stream) - 4
    kind, size = _HEAD(stream, at) if at <= last else (0, 0)
    while at <= last:
        begin, own, parts = at, kind, [stream[at + 4 : at + 4 + size]]
        at += 4 + size
        while at <= last:
            kind, size = _HEAD(stream, at)
            if kind != CONTINUE or own == CONTINUE:
                break
            parts.append(stream[at + 4 : at + 4 + size])
            at += 4 + size
        yield begin, own, parts


class _Book:
    def __init__(self, stream: bytes):
        self.stream, self.sheets, self.shared, self.formats, self.cell_formats, self.base = stream, [], [], {}, [], datetime(1899, 12, 30)
        for _, kind, parts in records(stream):
            data = parts[0]
            if kind == 0x0A:
                break
            if kind == BOUNDSHEET and data[5] == 0:
                self.sheets.append((struct.unpack_from("<I", data)[0], short_string(data[6:], 1)))
            elif kind == SST:
                strings = _Strings([data[8:], *parts[1:]])
                self.shared = [strings.string() for _ in range(struct.unpack_from("<I", data, 4)[0])]
            elif kind == FORMAT:
                self.formats[struct.unpack_from("<H", data)[0]] = short_string(data[2:], 2)
            elif kind == XF:
                self.cell_formats.append(struct.unpack_from("<H", data, 2)[0])
            elif kind == DATEMODE and data[:2] == b"\1\0":
                self.base = datetime(1904, 1, 1)

    def number(self, x: float, xf: int) -> str:
        n = self.cell_formats[xf] if xf < len(self.cell_formats) else 0
        return date_text(x, self.base) if is_date_format(n, self.formats.get(n)) else number_text(x)


def _sheet(book: _Book, offset: int, name: str, o: Options) -> Iterator[Piece]:
    cells: dict[tuple[int, int], str] = {}
    texts: dict[int, str] = {}
    notes: list[tuple[int, int, int]] = []
    shapes: list[int] = []
    last_object, pending, depth = None, None, 0
    for _, kind, parts in records(book.stream, offset):
        data = parts[0]
        if kind == 0x809:
            depth += 1
        elif kind == 0x0A:
            depth -= 1
            if depth == 0:
                break
        elif depth > 1:
            continue
        elif kind == FORMULA:
            row, column, _ = _CELL(data)
            if o.formulas:
                size = struct.unpack_from("<H", data, 20)[0]
                cells[row, column] = "=" + formula_text(data[22 : 22 + size], row, column)
            elif data[12:14] != b"\xff\xff":
                cells[row, column] = number_text(struct.unpack_from("<d", data, 6)[0])
            elif data[6] == 0:
                pending = row, column
            elif data[6] == 1:
                cells[row, column] = "TRUE" if data[8] else "FALSE"
            elif data[6] == 2:
                cells[row, column] = ERRORS.get(data[8], "")
        elif kind == STRING and pending:
            cells[pending] = _Strings(parts).string()
            pending = None
        elif kind == NOTE:
            row, column, _, obj = struct.unpack_from("<HHHH", data)
            notes.append((row, column, obj))
        elif kind == OBJ and len(data) >= 8:
            last_object = struct.unpack_from("<HH", data, 4)
            if last_object[0] != 0x19:
                shapes.append(last_object[1])
        elif kind == TXO and last_object and len(parts) > 1:
            n = struct.unpack_from("<H", data, 10)[0]
            text = ""
            for part in parts[1:]:
                if len(text) < n:
                    wide = part[0] & 1
                    text += part[1:].decode("utf-16-le" if wide else "latin-1", "replace")
            texts[last_object[1]] = text[:n]
        elif o.formulas:
            continue
        elif kind == LABELSST:
            row, column, _, k = struct.unpack_from("<HHHI", data)
            cells[row, column] = book.shared[k] if k < len(book.shared) else ""
        elif kind in (LABEL, RSTRING):
            row, column = struct.unpack_from("<HH", data)
            cells[row, column] = short_string(data[6:], 2)
        elif kind == NUMBER:
            row, column, xf, x = struct.unpack_from("<HHHd", data)
            cells[row, column] = book.number(x, xf)
        elif kind == RK:
            row, column, xf, x = struct.unpack_from("<HHHI", data)
            cells[row, column] = book.number(rk(x), xf)
        elif kind == MULRK:
            row, column = struct.unpack_from("<HH", data)
            for k in range((len(data) - 6) // 6):
                xf, x = struct.unpack_from("<HI", data, 4 + 6 * k)
                cells[row, column + k] = book.number(rk(x), xf)
        elif kind == BOOLERR:
            row, column, _, x, error = struct.unpack_from("<HHHBB", data)
            cells[row, column] = ERRORS.get(x, "") if error else ("TRUE" if x else "FALSE")
    said = defaultdict(list)
    for row, column, obj in notes:
        said[row, column].append(texts.get(obj, ""))
    for row, column in sorted(set(cells) | set(said)):
        at = address(row, column)
        if not blank(cells.get((row, column))):
            yield Piece(cells[row, column], row + 1, name, at)
        for text in said[row, column]:
            if not blank(text):
                yield Piece(text, 0, name, at, o.labels["comment"])
    n = 1
    for obj in shapes:
        lines = [x for x in new_lines(texts.get(obj, "")) if not blank(x)]
        for x in lines:
            yield Piece(x, 0, name, None, f"{o.labels['shape']}{n}")
        n += bool(lines)


def read(raw: bytes, o: Options) -> Iterator[Piece]:
    f = CompoundFile(raw)
    book = _Book(f.stream("Workbook" if f.has("Workbook") else "Book"))
    for offset, name in book.sheets:
        yield from _sheet(book, offset, name, o)
