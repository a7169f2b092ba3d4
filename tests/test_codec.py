"""Encodings against published vectors, round trips and corruption."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from treeloom.functions import codec

HELLO = bytes.fromhex("0005ea8f163db38682925e4491c5e58d4bb3506ef8c14eb78a86e908c5624a67")


def test_blake3_vectors():
    counted = lambda n: bytes(i % 251 for i in range(n))  # noqa: E731  as in the published test vectors
    assert codec.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert codec.blake3(counted(1024)).hex().startswith("42214739f095a406f3fc83deb889744a")
    assert codec.blake3(counted(3072)).hex().startswith("b98cb0ff3623be03326b373de6b90952")
    assert codec.blake3(counted(5120)).hex().startswith("9cadc15fed8b5d854562b26a9536d970")
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 7000]
    assert codec.blake3_many([counted(n) for n in sizes]) == [codec.blake3(counted(n)) for n in sizes]


def test_known_key_and_reference():
    assert codec.blob(b"hello")[0] == HELLO
    r = codec.Reference("n", HELLO, "u", 42)
    assert r.encoded().hex() == "a400616e015820" + HELLO.hex() + "02617503182a"
    assert codec.Reference.decoded(r.encoded()) == r
    signed = codec.Reference("n", HELLO, "u", 1765432100123456789, b"sig", b"pub")
    assert codec.Reference.decoded(signed.encoded()) == signed
    assert signed.signed_bytes() == codec.Reference("n", HELLO, "u", 1765432100123456789, b"", b"pub").encoded()


@pytest.mark.parametrize("bad", [b"", b"\xa0", b"\xa5" + codec.Reference("n", HELLO, "u", 42).encoded()[1:] + b"\x06\x00", codec.Reference("n", HELLO, "u", 42).encoded().replace(b"\x18\x2a", b"\x19\x00\x2a")])
def test_reference_rejects_other_encodings(bad):
    with pytest.raises(codec.Malformed):
        codec.Reference.decoded(bad)


@pytest.mark.parametrize("name,fine", [("a", True), ("a//b", True), ("a/../b", True), ("x" * 1024, True), ("", False), ("x" * 1025, False), ("a@b", False), ("a\x01", False), ("a\x7f", False)])
def test_names(name, fine):
    if fine:
        codec.check_name(name, False)
    else:
        with pytest.raises(codec.Malformed):
            codec.check_name(name, False)


def test_crc32c():
    assert codec.crc32c(b"123456789") == 0xE3069283


@given(st.binary(max_size=300))
def test_record_round_trip(data):
    k, _ = codec.blob(data)
    raw = codec.encode_record(k, data)
    r = codec.parse_record(raw + b"more")
    assert (r.key, r.ulen, codec.payload(r)) == (k, len(data), data)
    assert r.slen < r.ulen if r.flags else r.slen == r.ulen


def test_record_corruption_and_truncation():
    data = b"abc" * 40
    raw = codec.encode_record(codec.blob(data)[0], data)
    for n in range(len(raw)):
        with pytest.raises(codec.Malformed):
            codec.parse_record(raw[:n])
        with pytest.raises(codec.Malformed):
            codec.parse_record(raw[:n] + bytes([raw[n] ^ 0x55]) + raw[n + 1 :])


def test_pack_round_trip_and_faults():
    objects = [codec.blob(x) for x in (b"", b"one", b"two" * 500)]
    pack = codec.write_pack([codec.encode_record(k, d) for k, d in objects])
    assert [(r.key, codec.payload(r)) for r in codec.read_pack(pack)] == objects
    assert codec.read_pack(codec.write_pack([])) == []
    for bad in (b"", pack[:-1], b"X" + pack[1:], pack[:7] + b"\x02" + pack[8:], pack[:8] + b"\x07" + pack[9:]):
        with pytest.raises(codec.Malformed):
            codec.read_pack(bad)


def test_key_rules():
    assert codec.key_length(codec.make_key(1, 300, b"")) == 300
    for k, why in ((HELLO[:31], "length"), (b"\x08" + HELLO[1:], "reserved bit"), (b"\x50" + HELLO[1:], "reserved type"), (b"\x01\x00" + HELLO[2:], "non-canonical")):
        with pytest.raises(codec.Malformed, match=why):
            codec.check_key(k)


def test_objects():
    empty, body = codec.dir_leaf([])
    assert body == b"\x80" and codec.key_length(empty) == 1
    blob, _ = codec.blob(b"12345")
    node, data = codec.file_node([blob, blob])
    assert codec.key_length(node) == 10 and codec.children(node, data) == [("file_child", blob)] * 2
    xk, _ = codec.xattr_set({b"user.a": b"1"})
    leaf, data = codec.dir_leaf([codec.Entry(b"f", 0o100644, content=blob, xattrs_key=xk), codec.Entry(b"l", 0o120777, target=b"f")])
    assert codec.key_length(leaf) == len(data) + 5 + codec.key_length(xk)
    assert codec.children(leaf, data) == [("content", blob), ("xattrs", xk)]
    assert [e.name for e in codec.entries(data)] == [b"f", b"l"]
    top, data = codec.dir_node([(b"l", leaf)])
    assert codec.key_length(top) == len(data) + codec.key_length(leaf)
    assert codec.verify_object(blob, b"12345") is None and codec.verify_object(blob, b"1234") == "length" and codec.verify_object(blob, b"54321") == "hash"


def test_xattrs():
    pairs = {b"bb": b"1", b"a": b"2", b"ab": b"3"}
    data = codec.encode_xattrs(pairs)
    assert data.hex() == "a3" + "4161" + "4132" + "426162" + "4133" + "426262" + "4131"  # shorter names first
    assert codec.decode_xattrs(data) == pairs
    with pytest.raises(codec.Malformed):
        codec.decode_xattrs(b"\xbb\xff\xff\xff\xff\xff\xff\xff\xff")
    with pytest.raises(codec.Malformed):
        codec.decode_xattrs(data + b"\x00")


def test_meta_header():
    raw = codec.meta_header("r", HELLO, 7)
    assert codec.read_meta_header(raw + b"body") == ("r", HELLO, 7, len(raw))
    for n in range(len(raw)):
        with pytest.raises(codec.Malformed):
            codec.read_meta_header(raw[:n])


def test_one_decimal_is_exact(spark):
    from treeloom.functions import display

    values = [i / 20 for i in range(2001)] + [i / 7 for i in range(700)] + [0.25, 0.75, 99.95, 100.0, 1e-9]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [f"{r['y']:.1f}" for r in df.select(display.one_decimal(df.x).alias("y")).collect()]
    assert got == [f"{x:.1f}" for x in values]


def test_many_sums_and_hashes_are_those_of_each():
    import random

    r = random.Random(2)
    data = [r.randbytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 128, 1000, 5000, 100_000)]

    def plain(x):
        c = 0xFFFFFFFF
        for b in x:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ 0x82F63B78 * (c & 1)
        return c ^ 0xFFFFFFFF

    assert codec.crc32c_many(data) == [plain(x) for x in data] and codec.crc32c(b"123456789") == 0xE3069283
    assert codec.crc32c(data[8][300:], codec.crc32c(data[8][:300])) == codec.crc32c(data[8])
    assert codec.blake3_many(data) == [codec.blake3(x) for x in data]


def test_chunks_follow_the_algorithm_byte_by_byte():
    import random

    from treeloom.operators import cdc

    def plain(data, start, sizes):
        """The algorithm as it is told: step by step, with a running distance."""
        n = min(len(data) - start, sizes.most)
        if n <= sizes.least or n < sizes.least + 8:
            return start + n
        window, place, run = data[start + sizes.least : start + sizes.least + 8], sizes.least + 8, 0
        while place + 8 <= n:
            step = data[start + place : start + place + 8]
            if step == window:
                run += 1
                if run == cdc.LOW_ENTROPY_RUN:
                    return start + place + 8
            else:
                run = 0
                for j in range(8):
                    seen = data[start + place - 8 + j : start + place + j]
                    if sum(bin(x ^ cdc.PATTERN).count("1") for x in seen) & (cdc.MASK_BEFORE if place < min(n, sizes.normal) else cdc.MASK_BEHIND) == 0:
                        return start + place + j
            window, place = step, place + 8
        return start + n

    r = random.Random(3)
    for t in range(60):
        n = r.choice([0, 7, 16, 63, 1000, 6000])
        data = r.choice([r.randbytes(n), bytes(r.choice(b"ab") for _ in range(n)), b"\0" * n, b"abcdefgh" * (n // 8) + r.randbytes(n % 97)])
        for sizes in (cdc.Sizes(64, 256, 1024), cdc.Sizes(8, 9, 10), cdc.Sizes(10, 33, 2000)):
            want, at = [], 0
            while at < len(data):
                end = plain(data, at, sizes)
                want.append(data[at:end])
                at = end
            assert cdc.chunks(data, sizes) == want


def test_packs_opened_together_are_those_opened_alone(monkeypatch):
    from treeloom.streaming import inbox

    blobs = [codec.blob(f"text {i} ".encode() * (i + 1)) for i in range(40)]
    frames = codec.encode_records(blobs)
    head = codec.meta_header("r", blobs[0][0], 1)
    wrong = codec.encode_record(blobs[0][0], blobs[0][1][:-1] + b"?")
    long = codec.encode_record(codec.make_key(codec.BLOB, 3, b"abcd"), b"abcd")
    shut = bytearray(codec.encode_record(codec.make_key(codec.BLOB, 900, b"a" * 900), b"a" * 900))
    shut[46:50] = b"????"
    shut[42:46] = codec.crc32c(bytes(shut[:42]) + bytes(4) + bytes(shut[46:])).to_bytes(4, "big")
    harmed = bytearray(frames[3])
    harmed[-1] ^= 1
    bodies = [[], frames, [frames[0], wrong, frames[1]], [long], [bytes(shut)], [wrong, bytes(shut)], [bytes(shut), wrong], [frames[1], bytes(harmed)], frames[:1]]
    files = [(f"p{i}", head + codec.write_pack(x)) for i, x in enumerate(bodies)]
    files += [("cut", files[1][1][:-1]), ("magic", head + b"?" + files[1][1][len(head) + 1 :]), ("header", b"\0\0"), ("again", files[1][1])]
    alone = [row for x in files for row in inbox.opened_rows([x])]
    errors = {path: error for path, *_, error in alone}
    assert [errors[f"p{i}"] for i in range(9)] == [None, None, "object hash", "object length", "zstd", "object hash", "zstd", "record checksum", None]
    assert errors["cut"] == "truncated before the end marker" and errors["magic"] == "magic" and errors["header"] == "truncated header"
    assert [(r[3], bytes(r[4])) for r in alone if r[0] == "again"] == blobs and [r[3:] for r in alone if r[0] == "p0"] == [(None, None, None)]
    calls, many = [], codec.blake3_many
    monkeypatch.setattr(codec, "blake3_many", lambda x: calls.append(len(x)) or many(x))
    assert inbox.opened_rows(files) == alone and len(calls) == 1


def test_leaves_made_together_are_those_made_alone(monkeypatch):
    many = [[codec.Entry(f"{i}-{j}".encode(), 0o100644, content=codec.blob(b"x" * j)[0]) for j in range(i % 9)] for i in range(60)]
    want = [codec.dir_leaf(es) for es in many]
    calls, hashed = [], codec.blake3_many
    monkeypatch.setattr(codec, "blake3_many", lambda x: calls.append(len(x)) or hashed(x))
    assert codec.dir_leaves(many) == want and calls == [60] and codec.dir_leaves([]) == []
