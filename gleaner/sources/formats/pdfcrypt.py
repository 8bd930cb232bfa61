"""The standard security handler of PDF, for files that open without a password: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

#: Fixed value: what pads a password.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@lru_cache(8)
def rc4_state(key: bytes) -> list[int]:
    """The permutation that a key begins with, kept for the strings of one object; to be copied."""
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = s[i]
        j = (j + x + k) & 255
        s[i] = s[j]
        s[j] = x
    return s


def rc4(key: bytes, data: bytes) -> bytes:
    if not data:
        return b""
    s = rc4_state(key).copy()
    out, i, j = bytearray(len(data)), 0, 0
    for k in range(len(data)):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        y = s[j]
        s[i], s[j] = y, x
        out[k] = s[(x + y) & 255]
    return (int.from_bytes(data) ^ int.from_bytes(out)).to_bytes(len(data))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The substitution of bytes, its inverse, and products in the field of 256 elements."""
    times = np.zeros((16, 256), np.uint8)
    for a in range(16):
        for b in range(256):
            x, y, product = a, b, 0
            while x:
                product ^= y if x & 1 else 0
                y = (y << 1) ^ (0x11B if y & 0x80 else 0)
                x >>= 1
            times[a, b] = product
    powers = [1]
    for _ in range(254):
        powers.append(powers[-1] ^ int(times[2, powers[-1]]))  # powers of three
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = powers[(255 - powers.index(x)) % 255] if x else 0
        turned = [(inverse << k | inverse >> (8 - k)) & 255 for k in range(5)]
        box[x] = turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back, times


@lru_cache(1)
def _box() -> list[int]:
    return _tables()[0].tolist()


@lru_cache(8)
def key_words(key: bytes) -> list[int]:
    """Words of the round keys, four a round."""
    box, n = _box(), len(key) // 4
    words = list(struct.unpack(f">{n}I", key))
    turn = 1
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = box[w >> 16 & 255] << 24 | box[w >> 8 & 255] << 16 | box[w & 255] << 8 | box[w >> 24]
            w ^= turn << 24
            turn = turn << 1 ^ (0x11B if turn & 0x80 else 0)
        elif n > 6 and k % n == 4:
            w = box[w >> 24] << 24 | box[w >> 16 & 255] << 16 | box[w >> 8 & 255] << 8 | box[w & 255]
        words.append(words[k - n] ^ w)
    return words


def round_keys(key: bytes) -> np.ndarray:
    """(rounds + 1, 16) bytes."""
    return np.array(key_words(key), ">u4").view(np.uint8).reshape(-1, 16)


#: Where each byte of a block comes from when its rows are shifted, and back.
_SHIFT = np.array([(4 * ((k // 4 + k % 4) % 4) + k % 4) for k in range(16)])
_BACK = np.argsort(_SHIFT)
#: Where the row of a byte begins in the table of columns.
_ROWS = np.tile(np.arange(4) * 256, 4)


@lru_cache(1)
def _mixed_back() -> np.ndarray:
    """What each byte of a block, by its row, adds to its column when columns are mixed back: four bytes as a word."""
    times = _tables()[2]
    table = np.empty((4, 256, 4), np.uint8)
    for r in range(4):
        for k, m in enumerate((14, 11, 13, 9)):
            table[r, :, (r - k) % 4] = times[m]
    return table.reshape(-1, 4).view(np.uint32).ravel()


def decrypt_blocks(key: bytes | np.ndarray, data: bytes) -> np.ndarray:
    """(blocks, 16) bytes, each block by itself. key: one for all, or the round keys of each block (rounds + 1, blocks, 16)."""
    back, mixed = _tables()[1], _mixed_back()
    keys = round_keys(key) if isinstance(key, bytes) else key
    x = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        x = back[x[:, _BACK]] ^ keys[k]
        if k:
            words = mixed[x + _ROWS].reshape(-1, 4, 4)
            x = np.ascontiguousarray(words[:, :, 0] ^ words[:, :, 1] ^ words[:, :, 2] ^ words[:, :, 3]).view(np.uint8)
    return x


@lru_cache(1)
def _columns() -> list[list[int]]:
    """What each byte of a block adds to its column in a round, as words."""
    box, _, times = _tables()
    words = []
    for r in range(4):
        row = []
        for x in range(256):
            s = int(box[x])
            column = [0, 0, 0, 0]
            for k, m in ((r, 2), ((r - 1) % 4, 3), ((r - 2) % 4, 1), ((r - 3) % 4, 1)):
                column[k] = int(times[m, s])
            row.append(int.from_bytes(bytes(column)))
        words.append(row)
    return words


def encrypt_block(keys: list[list[int]], box: list[int], block: tuple[int, ...]) -> tuple[int, ...]:
    """A block of four words."""
    t0, t1, t2, t3 = _columns()
    a, b, c, d = (x ^ k for x, k in zip(block, keys[0], strict=True))
    for k in keys[1:-1]:
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
        )
    last = lambda p, q, r, s, k: (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k
    k = keys[-1]
    return last(a, b, c, d, k[0]), last(b, c, d, a, k[1]), last(c, d, a, b, k[2]), last(d, a, b, c, k[3])


def encrypt_cbc(key: bytes, start: bytes, data: bytes) -> bytes:
    """Whole blocks, each mixed with the one before."""
    words, box = key_words(key), _box()
    keys = [words[k : k + 4] for k in range(0, len(words), 4)]
    state, out = struct.unpack(">4I", start), []
    for block in struct.iter_unpack(">4I", data):
        state = encrypt_block(keys, box, tuple(x ^ y for x, y in zip(state, block, strict=True)))
        out.append(struct.pack(">4I", *state))
    return b"".join(out)


def decrypt_cbc(key: bytes, start: bytes, data: bytes) -> bytes:
    if not data:
        return b""
    before = np.frombuffer(start + data[:-16], np.uint8).reshape(-1, 16)
    return (decrypt_blocks(key, data) ^ before).tobytes()


#: Data of more bytes is decrypted by itself, and so many bytes of smaller ones at once.
ALONE, TOGETHER = 64 << 10, 1 << 20


def aes(jobs: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Strings and streams (key, data), small ones of any keys together: the first block of each starts its chain, its last bytes say how many are padding."""
    out, held, size = [b""] * len(jobs), [], 0

    def flush() -> None:
        if not held:
            return
        data = [jobs[k][1][: len(jobs[k][1]) // 16 * 16] for k in held]
        keys = list(dict.fromkeys(jobs[k][0] for k in held))
        if len(keys) == 1:
            key = keys[0]
        else:
            known = {x: n for n, x in enumerate(keys)}
            which = np.repeat([known[jobs[k][0]] for k in held], [len(d) // 16 - 1 for d in data])
            key = np.stack([round_keys(x) for x in keys], 1)[:, which]
        before = np.frombuffer(b"".join(d[:-16] for d in data), np.uint8).reshape(-1, 16)
        whole, at = (decrypt_blocks(key, b"".join(d[16:] for d in data)) ^ before).tobytes(), 0
        for k, d in zip(held, data, strict=True):
            text = whole[at : at + len(d) - 16]
            at += len(text)
            out[k] = text[: -text[-1]] if 1 <= text[-1] <= 16 else text
        held.clear()

    for k, (_, data) in enumerate(jobs):
        if len(data) < 32:
            continue
        if len(data) > ALONE or size > TOGETHER:
            flush()
            size = 0
        held.append(k)
        size += len(data)
        if len(data) > ALONE:
            flush()
            size = 0
    flush()
    return out


def hash_6(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of encryption and of the three SHA-2 hashes, as many as the data itself says."""
    key, n, last = hashlib.sha256(password + salt + more).digest(), 0, 0
    while n < 64 or last > n - 32:
        data = encrypt_cbc(key[:16], key[16:32], (password + key + more) * 64)
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(data[:16]) % 3](data).digest()
        n, last = n + 1, data[-1]
    return key[:32]


class Security:
    """How the strings and streams of a file are decrypted, with the empty password."""

    def __init__(self, head: dict, first_id: bytes):
        """head: the dictionary, without references."""
        if head.get("Filter") != "Standard":
            raise ValueError(f"the file is encrypted by {head.get('Filter')}")
        version, self.revision = head.get("V", 0), head.get("R", 0)
        self.metadata = head.get("EncryptMetadata", True) is not False
        filters = {k: self._method(head, k) for k in ("StmF", "StrF")} if version >= 4 else {"StmF": "V2", "StrF": "V2"}
        self.streams, self.strings = filters["StmF"], filters["StrF"]
        bits = head.get("Length", 40) if version in (2, 3) else 128 if version == 4 else 40
        self.key = self._new_key(head) if self.revision >= 5 else self._old_key(head, first_id, bits // 8)

    @staticmethod
    def _method(head: dict, kind: str) -> str:
        name = head.get(kind, "Identity")
        return "None" if name == "Identity" else head.get("CF", {}).get(name, {}).get("CFM", "None")

    def _old_key(self, head: dict, first_id: bytes, size: int) -> bytes:
        data = PAD + head["O"][:32] + struct.pack("<I", head["P"] & 0xFFFFFFFF) + first_id
        key = hashlib.md5(data + b"\xff" * 4 * (self.revision >= 4 and not self.metadata)).digest()[:size]
        if self.revision == 2:
            right = rc4(key, PAD) == head["U"][:32]
        else:
            for _ in range(50):
                key = hashlib.md5(key).digest()[:size]
            told = hashlib.md5(PAD + first_id).digest()
            for k in range(20):
                told = rc4(bytes(x ^ k for x in key), told)
            right = told == head["U"][:16]
        if not right:
            raise ValueError("the file is encrypted with a password")
        return key

    def _new_key(self, head: dict) -> bytes:
        u = head["U"]
        told = hash_6 if self.revision >= 6 else lambda password, salt: hashlib.sha256(password + salt).digest()
        if told(b"", u[32:40]) != u[:32]:
            raise ValueError("the file is encrypted with a password")
        return decrypt_cbc(told(b"", u[40:48]), bytes(16), head["UE"][:32])

    def _key(self, method: str, number: int, generation: int) -> bytes:
        """The key of an object."""
        if method == "AESV3":
            return self.key
        tail = struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if method == "AESV2" else b"")
        return hashlib.md5(self.key + tail).digest()[: min(16, len(self.key) + 5)]

    def opened(self, sealed: list[tuple[str, int, int, bytes]]) -> list[bytes]:
        """What strings and streams (method, number and generation of the object, data) say."""
        keys = [self._key(m, n, g) for m, n, g, _ in sealed]
        of_aes = [k for k, x in enumerate(sealed) if x[0] in ("AESV2", "AESV3")]
        told = dict(zip(of_aes, aes([(keys[k], sealed[k][3]) for k in of_aes]), strict=True))
        return [told[k] if k in told else data if m == "None" else rc4(keys[k], data) for k, (m, _, _, data) in enumerate(sealed)]

    def stream(self, head: dict) -> str:
        """The method of a stream."""
        kind, filters = head.get("Type"), head.get("Filter")
        own = filters == "Crypt" or isinstance(filters, list) and "Crypt" in filters
        plain = kind == "XRef" or own or kind == "Metadata" and not self.metadata
        return "None" if plain else self.streams
