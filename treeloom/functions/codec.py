"""Digests, canonical encodings and record frames, as plain functions over bytes.

They follow public specifications: BLAKE3, CRC-32C, deterministic CBOR (RFC 8949, section 4.2) and
Zstandard. Arrow functions elsewhere apply them to columns."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

# --- BLAKE3 -----------------------------------------------------------------------------------

# Fixed values of the BLAKE3 specification: initial words, message permutation and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK = 1024


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


#: Lanes that are worked on together at most: 2 MB of state and block.
TILE = 1 << 14


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) of n lanes: cv (8, n), block (16, n)."""
    n = cv.shape[1]
    if n > TILE:
        return np.concatenate([_compress(*(x[..., i : i + TILE] for x in (cv, block, counter, size, flags))) for i in range(0, n, TILE)], axis=1)
    a, b, c = cv[:4].copy(), cv[4:].copy(), np.repeat(IV[:4, None], n, axis=1)
    d = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size, flags])
    room = np.empty_like(a)

    def turn(x, by):
        np.left_shift(x, np.uint32(32 - by), out=room)
        np.right_shift(x, np.uint32(by), out=x)
        np.bitwise_or(x, room, out=x)

    def quarters(b, c, d, x, y):
        """The four columns, or diagonals, at once."""
        nonlocal a
        for word, by_d, by_b in ((x, 16, 12), (y, 8, 7)):
            a += b
            a += word
            d ^= a
            turn(d, by_d)
            c += d
            b ^= c
            turn(b, by_b)

    order = np.arange(16)
    for _ in range(7):
        m = block[order]
        quarters(b, c, d, m[0:8:2], m[1:8:2])
        b, c, d = np.roll(b, -1, axis=0), np.roll(c, -2, axis=0), np.roll(d, -3, axis=0)
        quarters(b, c, d, m[8::2], m[9::2])
        b, c, d = np.roll(b, 1, axis=0), np.roll(c, 2, axis=0), np.roll(d, 3, axis=0)
        order = order[PERMUTATION]
    return np.concatenate([a ^ c, b ^ d])


def blake3_many(inputs: list[bytes]) -> list[bytes]:
    """BLAKE3-256 of each input; the chunks of all of them are lanes of one vector."""
    if not inputs:
        return []
    counts = [max(1, -(-len(b) // CHUNK)) for b in inputs]
    total = sum(counts)
    room = np.zeros((total, CHUNK), np.uint8)
    sizes, numbers, single = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    at = 0
    for b, n in zip(inputs, counts, strict=True):
        flat = room[at : at + n].reshape(-1)
        flat[: len(b)] = np.frombuffer(b, np.uint8)
        sizes[at : at + n] = CHUNK
        sizes[at + n - 1] = len(b) - (n - 1) * CHUNK
        numbers[at : at + n] = np.arange(n)
        single[at : at + n] = n == 1
        at += n
    words = room.view("<u4").reshape(total, 16, 16)
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.repeat(IV[:, None], total, axis=1)
    for k in range(16):
        lanes = np.flatnonzero(blocks > k)
        if not len(lanes):
            break
        last = blocks[lanes] == k + 1
        flags = np.where(last, CHUNK_END | np.where(single[lanes], ROOT, 0), 0) | (CHUNK_START if k == 0 else 0)
        size = np.where(last, sizes[lanes] - 64 * k, 64)
        cv[:, lanes] = _compress(cv[:, lanes], np.ascontiguousarray(words[lanes, k].T), numbers[lanes], size.astype(np.uint32), flags.astype(np.uint32))
    # pairs of neighbours become parents; one left over moves up as it is
    starts = np.cumsum([0, *counts])
    levels = [cv[:, starts[i] : starts[i + 1]] for i in range(len(inputs))]
    while True:
        todo = [i for i, x in enumerate(levels) if x.shape[1] > 1]
        if not todo:
            break
        left = np.concatenate([levels[i][:, 0 : levels[i].shape[1] // 2 * 2 : 2] for i in todo], axis=1)
        right = np.concatenate([levels[i][:, 1::2] for i in todo], axis=1)
        flags = np.concatenate([np.full(levels[i].shape[1] // 2, PARENT | (ROOT if levels[i].shape[1] == 2 else 0), np.uint32) for i in todo])
        n = left.shape[1]
        up = _compress(np.repeat(IV[:, None], n, axis=1), np.concatenate([left, right]), np.zeros(n, np.int64), np.full(n, 64, np.uint32), flags)
        at = 0
        for i in todo:
            half = levels[i].shape[1] // 2
            levels[i] = np.concatenate([up[:, at : at + half], levels[i][:, 2 * half :]], axis=1)
            at += half
    return [np.ascontiguousarray(x[:, 0]).astype("<u4").tobytes() for x in levels]


#: Bytes that are hashed together at most: enough lanes to outweigh a call's cost, and a bound of what a task holds.
TOGETHER = 8 << 20


def together(items: Iterable, size: Callable[[object], int] = len, most: int = TOGETHER) -> Iterator[list]:
    """Neighbouring items in lists of at most so many bytes; a larger item stands alone."""
    held, n = [], 0
    for x in items:
        if held and n + size(x) > most:
            yield held
            held, n = [], 0
        held.append(x)
        n += size(x)
    if held:
        yield held


def blake3(data: bytes) -> bytes:
    return blake3_many([data])[0]


# --- CRC-32C ----------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """By its polynomial, bits reversed."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


CRC_TABLE = _crc_table()
CRC_LANE = 64


def _crc_shift(size: int) -> np.ndarray:
    """What `size` zero bytes make of a state: for each of its four bytes a table of 256, to be joined by xor."""
    one = np.array([1 << i for i in range(32)], np.uint32)
    for _ in range(size):
        one = CRC_TABLE[one & 0xFF] ^ (one >> np.uint32(8))
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, np.arange(256) >> bit & 1 == 1] ^= one[8 * byte + bit]
    return table


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 0xFF] ^ table[1][state >> 8 & 0xFF] ^ table[2][state >> 16 & 0xFF] ^ table[3][state >> 24]


_SHIFTS: list[np.ndarray] = []


def _shift(level: int) -> np.ndarray:
    """The tables for 2**level lanes of zero bytes."""
    while len(_SHIFTS) <= level:
        if _SHIFTS:
            last = _SHIFTS[-1]
            _SHIFTS.append(np.stack([_apply(last, row) for row in last]))
        else:
            _SHIFTS.append(_crc_shift(CRC_LANE))
    return _SHIFTS[level]


def crc32c_many(inputs: list[bytes], before: int = 0) -> list[int]:
    """CRC-32C of each input; lanes of all of them are worked on together.

    An input is cut into a power of two of lanes, with zero bytes in front, which don't change an empty state.
    The first state is xored into an input's first four bytes; neighbouring lanes are joined level by level."""
    short = [i for i, x in enumerate(inputs) if len(x) < 4]
    out = [0] * len(inputs)
    for i in short:
        c = before ^ 0xFFFFFFFF
        for x in inputs[i]:
            c = int(CRC_TABLE[(c ^ x) & 0xFF]) ^ (c >> 8)
        out[i] = c ^ 0xFFFFFFFF
    todo = [i for i, x in enumerate(inputs) if len(x) >= 4]
    if not todo:
        return out
    lanes = np.array([1 << max(0, (-(-len(inputs[i]) // CRC_LANE) - 1).bit_length()) for i in todo], np.int64)
    ends = np.cumsum(lanes)
    room = np.zeros(int(ends[-1]) * CRC_LANE, np.uint8)
    start = np.frombuffer(((before ^ 0xFFFFFFFF) & 0xFFFFFFFF).to_bytes(4, "little"), np.uint8)
    for i, end in zip(todo, (ends * CRC_LANE).tolist(), strict=True):
        at = end - len(inputs[i])
        room[at:end] = np.frombuffer(inputs[i], np.uint8)
        room[at : at + 4] ^= start
    columns = np.ascontiguousarray(room.reshape(-1, CRC_LANE).T)
    state = np.zeros(len(columns[0]), np.uint32)
    for column in columns:
        state = CRC_TABLE[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    for level in range(int(lanes.max()).bit_length() - 1):
        many = lanes > 1
        wide = np.repeat(many, lanes)
        pairs = state[wide]
        lanes = np.where(many, lanes // 2, lanes)
        after, wide_after = np.empty(int(lanes.sum()), np.uint32), np.repeat(many, lanes)
        after[wide_after], after[~wide_after] = _apply(_shift(level), pairs[0::2]) ^ pairs[1::2], state[~wide]
        state = after
    for i, c in zip(todo, state.tolist(), strict=True):
        out[i] = c ^ 0xFFFFFFFF
    return out


def crc32c(data: bytes, before: int = 0) -> int:
    return crc32c_many([data], before)[0]


# --- Deterministic CBOR: whole numbers, byte and text strings, arrays, maps ---------------------


class Malformed(ValueError):
    """Bytes that don't follow their format."""


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise Malformed("number too large")


def dumps(x) -> bytes:
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, (bytes, bytearray)):
        return head(2, len(x)) + bytes(x)
    if isinstance(x, str):
        raw = x.encode()
        return head(3, len(raw)) + raw
    if isinstance(x, Raw):
        return x.data
    if isinstance(x, (list, tuple)):
        return head(4, len(x)) + b"".join(map(dumps, x))
    if isinstance(x, dict):
        pairs = sorted((dumps(k), dumps(v)) for k, v in x.items())
        return head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    raise TypeError(type(x))


@dataclass(frozen=True)
class Raw:
    """Bytes that are an encoding already."""

    data: bytes


def read(data: bytes, at: int = 0, strict: bool = True):
    """(value, place behind it). strict: the shortest heads, and maps in order without repeats."""
    if at >= len(data):
        raise Malformed("truncated")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if info >= 28 or info == 31:
        raise Malformed("indefinite or reserved length")
    n = info
    if info >= 24:
        size = 1 << info - 24
        if at + size > len(data):
            raise Malformed("truncated")
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if strict and (n < 24 or size > 1 and n < 1 << 4 * size):
            raise Malformed("not the shortest head")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n > len(data) - at:
            raise Malformed("truncated")
        raw = data[at : at + n]
        try:
            return (raw if major == 2 else raw.decode()), at + n
        except UnicodeDecodeError as e:
            raise Malformed("text isn't UTF-8") from e
    if major == 4:
        if n > len(data) - at:
            raise Malformed("count beyond the data")
        out = []
        for _ in range(n):
            x, at = read(data, at, strict)
            out.append(x)
        return out, at
    if major == 5:
        if n > (len(data) - at) // 2:
            raise Malformed("count beyond the data")
        pairs, last = {}, None
        for _ in range(n):
            before = at
            k, at = read(data, at, strict)
            code = data[before:at]
            if strict and last is not None and code <= last:
                raise Malformed("map out of order")
            last = code
            pairs[k], at = read(data, at, strict)
        return pairs, at
    raise Malformed("unused major type")


def loads(data: bytes, strict: bool = True):
    x, at = read(data, 0, strict)
    if at != len(data):
        raise Malformed("trailing bytes")
    return x


# --- Keys and objects --------------------------------------------------------------------------

BLOB, FILE_NODE, DIR_LEAF, DIR_NODE, XATTR_SET = range(5)
KEY_BYTES = 32


def make_key(otype: int, length: int, data: bytes, digest=blake3) -> bytes:
    size = max(1, (length.bit_length() + 7) // 8)
    return bytes([otype << 4 | size - 1]) + length.to_bytes(size, "big") + digest(data)[: 31 - size]


def make_keys(objects: list[tuple[int, int, bytes]]) -> list[bytes]:
    """make_key() of many (type, length, data), hashed together."""
    return [make_key(t, n, b"", lambda _, h=h: h) for (t, n, _), h in zip(objects, blake3_many([x for *_, x in objects]), strict=True)]


def key_length(k: bytes) -> int:
    return int.from_bytes(k[1 : 2 + (k[0] & 7)], "big")


def key_type(k: bytes) -> int:
    return k[0] >> 4


def check_key(k: bytes) -> None:
    if len(k) != KEY_BYTES:
        raise Malformed("length")
    if k[0] & 8:
        raise Malformed("reserved bit")
    if k[0] >> 4 > XATTR_SET:
        raise Malformed("reserved type")
    if k[1] == 0 and k[0] & 7:
        raise Malformed("non-canonical length")


@dataclass
class Entry:
    """A directory entry; exactly the payload that its file type asks for is set."""

    name: bytes
    mode: int = 0
    uid: int = 0
    gid: int = 0
    mtime_ns: int = 0
    content: bytes | None = None
    target: bytes | None = None
    rdev: tuple[int, int] | None = None
    xattrs: bytes | None = None
    xattrs_key: bytes | None = None

    def encoded(self) -> bytes:
        whole = [self.name, self.mode, self.uid, self.gid, self.mtime_ns, self.content, self.target, list(self.rdev) if self.rdev else None, Raw(self.xattrs) if self.xattrs else None, self.xattrs_key]
        return dumps({i: x for i, x in enumerate(whole) if i < 5 or x})

    @staticmethod
    def of(m: dict) -> Entry:
        if not isinstance(m, dict) or not set(range(5)) <= set(m):
            raise Malformed("entry lacks a field")
        return Entry(m[0], m[1], m[2], m[3], m[4], m.get(5), m.get(6), tuple(m[7]) if m.get(7) else None, dumps(m[8]) if 8 in m else None, m.get(9))


def blob(data: bytes, digest=blake3) -> tuple[bytes, bytes]:
    return make_key(BLOB, len(data), data, digest), data


def file_node(children: list[bytes], digest=blake3) -> tuple[bytes, bytes]:
    data = dumps(children)
    return make_key(FILE_NODE, sum(map(key_length, children)), data, digest), data


def below(data: bytes) -> int:
    """The bytes that a directory leaf's entries hold below them."""
    return sum(key_length(m[i]) for m in loads(data) for i in (5, 9) if m.get(i))


def dir_leaf(entries: list[Entry], digest=blake3) -> tuple[bytes, bytes]:
    data = head(4, len(entries)) + b"".join(e.encoded() for e in entries)
    return make_key(DIR_LEAF, len(data) + below(data), data, digest), data


def dir_leaves(many: list[list[Entry]]) -> list[tuple[bytes, bytes]]:
    """dir_leaf() of each list of entries, hashed together."""
    parts = [head(4, len(es)) + b"".join(e.encoded() for e in es) for es in many]
    return list(zip(make_keys([(DIR_LEAF, len(x) + below(x), x) for x in parts]), parts, strict=True))


def dir_node(pairs: list[tuple[bytes, bytes]], digest=blake3) -> tuple[bytes, bytes]:
    data = dumps([list(p) for p in pairs])
    return make_key(DIR_NODE, len(data) + sum(key_length(c) for _, c in pairs), data, digest), data


def encode_xattrs(attributes: dict[bytes, bytes]) -> bytes:
    return dumps({bytes(k): bytes(v) for k, v in attributes.items()})


def decode_xattrs(data: bytes) -> dict[bytes, bytes]:
    """Lenient as to head sizes and order; a repeated name takes the last value."""
    x = loads(data, strict=False)
    if not isinstance(x, dict) or not all(isinstance(i, bytes) for p in x.items() for i in p):
        raise Malformed("not a map of byte strings")
    return x


def xattr_set(attributes: dict[bytes, bytes], digest=blake3) -> tuple[bytes, bytes]:
    data = encode_xattrs(attributes)
    return make_key(XATTR_SET, len(data), data, digest), data


def children(k: bytes, data: bytes) -> list[tuple[str, bytes]]:
    """(role, key) of an object's direct children in their order."""
    kind = key_type(k)
    if kind == FILE_NODE:
        return [("file_child", c) for c in loads(data)]
    if kind == DIR_NODE:
        return [("dir_child", c) for _, c in loads(data)]
    if kind == DIR_LEAF:
        return [(role, c) for m in loads(data) for role, c in (("content", m.get(5)), ("xattrs", m.get(9))) if c]
    return []


def entries(data: bytes) -> list[Entry]:
    return [Entry.of(m) for m in loads(data)]


def verify_object(k: bytes, data: bytes, digest=blake3) -> str | None:
    """Why an object's bytes don't fit its key; None if they do. Index types' lengths are taken as they are."""
    if key_type(k) in (BLOB, XATTR_SET) and key_length(k) != len(data):
        return "length"
    return None if make_key(key_type(k), key_length(k), data, digest) == k else "hash"


def verify_many(objects: list[tuple[bytes, bytes]]) -> list[str | None]:
    """verify_object() of many (key, payload) pairs, hashed together."""
    hashes = blake3_many([data for _, data in objects])
    return [verify_object(k, data, lambda _, h=h: h) for (k, data), h in zip(objects, hashes, strict=True)]


# --- Records and wire packs --------------------------------------------------------------------

RECORD_HEADER, MAX_PAYLOAD = 46, 256 << 20
TAG_RECORD, TAG_END, FLAG_ZSTD = 1, 0, 1
#: The first bytes of a wire pack: a parameter, with this package's own as the default.
PACK_MAGIC = b"TREELPK\x03"


@dataclass
class Record:
    key: bytes
    flags: int
    ulen: int
    slen: int
    data: bytes = field(repr=False)


def encode_records(objects: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Frames of (key, payload) pairs; a payload is compressed if that makes it smaller."""
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    fronts, bodies = [], []
    for k, data in objects:
        if len(data) > MAX_PAYLOAD:
            raise Malformed("payload too large")
        packed = pack(data)
        smaller = len(packed) < len(data)
        bodies.append(packed if smaller else data)
        fronts.append(struct.pack(">B32sBII", TAG_RECORD, k, FLAG_ZSTD if smaller else 0, len(data), len(bodies[-1])))
    sums = crc32c_many([front + bytes(4) + body for front, body in zip(fronts, bodies, strict=True)])
    return [front + crc.to_bytes(4, "big") + body for front, crc, body in zip(fronts, sums, bodies, strict=True)]


def encode_record(k: bytes, payload: bytes) -> bytes:
    return encode_records([(k, payload)])[0]


def framed(data: bytes) -> Record:
    """The record at the start of data by its header alone; bytes behind it don't matter."""
    if len(data) < RECORD_HEADER:
        raise Malformed("truncated record header")
    tag, k, flags, ulen, slen, _ = struct.unpack_from(">B32sBIII", data)
    rules = {
        "record tag": tag == TAG_RECORD,
        "record flags": flags in (0, FLAG_ZSTD),
        "payload too large": ulen <= MAX_PAYLOAD,
        "stored length": slen < ulen if flags else slen == ulen,
        "truncated record payload": RECORD_HEADER + slen <= len(data),
    }
    if broken := [why for why, holds in rules.items() if not holds]:
        raise Malformed(", ".join(broken))
    return Record(k, flags, ulen, slen, data[: RECORD_HEADER + slen])


def record_faults(records: list[Record]) -> list[Malformed | None]:
    """Why each record's checksum, or else its key, is wrong; checksums are worked out together, 1 MB at a time."""
    out, sums = [], []
    for some in together(records, lambda r: len(r.data), 1 << 20):
        sums += crc32c_many([r.data[:42] + bytes(4) + r.data[46:] for r in some])
    for r, real in zip(records, sums, strict=True):
        try:
            if int.from_bytes(r.data[42:46], "big") != real:
                raise Malformed("record checksum")
            check_key(r.key)
            out.append(None)
        except Malformed as e:
            out.append(e)
    return out


def checked(records: list[Record]) -> list[Record]:
    """The records, if their checksums and keys are right."""
    for fault in record_faults(records):
        if fault:
            raise fault
    return records


def parse_record(data: bytes) -> Record:
    """The record at the start of data."""
    return checked([framed(data)])[0]


def unpacked(flags: int, ulen: int, stored: bytes) -> bytes:
    """A payload from what a record holds of it."""
    import zstandard

    if not flags:
        return stored
    try:
        out = zstandard.ZstdDecompressor().decompress(stored, max_output_size=max(1, ulen))
    except zstandard.ZstdError as e:
        raise Malformed("zstd") from e
    if len(out) != ulen:
        raise Malformed("decompressed length")
    return out


def payload(r: Record) -> bytes:
    return unpacked(r.flags, r.ulen, r.data[RECORD_HEADER:])


def write_pack(records: list[bytes], magic: bytes = PACK_MAGIC) -> bytes:
    return magic + b"".join(records) + bytes([TAG_END])


def pack_frames(data: bytes, magic: bytes = PACK_MAGIC) -> list[Record]:
    """A pack's records by their headers alone."""
    if data[: len(magic)] != magic:
        raise Malformed("magic")
    at, out = len(magic), []
    while True:
        if at >= len(data):
            raise Malformed("truncated before the end marker")
        if data[at] == TAG_END:
            return out
        if data[at] != TAG_RECORD:
            raise Malformed("record tag")
        r = framed(data[at : at + RECORD_HEADER + int.from_bytes(data[at + 38 : at + 42], "big")])
        out.append(r)
        at += len(r.data)


def read_pack(data: bytes, magic: bytes = PACK_MAGIC) -> list[Record]:
    return checked(pack_frames(data, magic))


def read_packs(packs: list[bytes], magic: bytes = PACK_MAGIC) -> list[list[Record] | Malformed]:
    """read_pack() of each pack, all records checked together; a malformed one gives its error."""
    out = []
    for data in packs:
        try:
            out.append(pack_frames(data, magic))
        except Malformed as e:
            out.append(e)
    faults = iter(record_faults([r for x in out if isinstance(x, list) for r in x]))
    for i, x in enumerate(out):
        if isinstance(x, list):
            out[i] = next(filter(None, [next(faults) for _ in x]), x)
    return out


# --- References and staged packs ---------------------------------------------------------------

MOST_NAME, MOST_SIGNATURE, MOST_PUBLIC_KEY = 1024, 1024, 1024


@dataclass
class Reference:
    name: str
    key: bytes
    user: str = ""
    created_at_ns: int = 0
    signature: bytes = b""
    public_key: bytes = b""

    def check(self) -> None:
        check_name(self.name, False)
        check_key(self.key)
        if self.user:
            check_name(self.user, True)
        if len(self.signature) > MOST_SIGNATURE or len(self.public_key) > MOST_PUBLIC_KEY:
            raise Malformed("signature or public key too long")

    def encoded(self, signed: bool = True) -> bytes:
        self.check()
        whole = {0: self.name, 1: self.key, 2: self.user, 3: self.created_at_ns}
        if signed and self.signature:
            whole[4] = self.signature
        if self.public_key:
            whole[5] = self.public_key
        return dumps(whole)

    def signed_bytes(self) -> bytes:
        """What a signature covers: all but itself."""
        return self.encoded(signed=False)

    @staticmethod
    def decoded(data: bytes) -> Reference:
        m = loads(data)
        if not isinstance(m, dict) or not {0, 1, 2, 3} <= set(m) <= set(range(6)):
            raise Malformed("reference fields")
        out = Reference(m[0], m[1], m[2], m[3], m.get(4, b""), m.get(5, b""))
        if out.encoded() != data:
            raise Malformed("reference encoding isn't canonical")
        return out


def check_name(name: str, at_sign: bool) -> None:
    raw = name.encode("utf-8", "strict")
    if not 1 <= len(raw) <= MOST_NAME:
        raise Malformed("name length")
    if any(c < " " or c == "\x7f" or c == "@" and not at_sign for c in name):
        raise Malformed("name character")


def meta_header(ref: str, root: bytes, received_at_ns: int) -> bytes:
    m = dumps({0: ref, 1: root, 2: received_at_ns})
    return struct.pack(">I", len(m)) + m


def read_meta_header(data: bytes) -> tuple[str, bytes, int, int]:
    """(ref, root, received_at_ns, place of the body)."""
    if len(data) < 4:
        raise Malformed("truncated header")
    n = struct.unpack(">I", data[:4])[0]
    if len(data) < 4 + n:
        raise Malformed("truncated header")
    m = loads(data[4 : 4 + n])
    if not isinstance(m, dict) or not {0, 1, 2} <= set(m):
        raise Malformed("header fields")
    return m[0], m[1], m[2], 4 + n
