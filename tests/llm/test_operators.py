"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import blob_ledger, decontam, extract, lines, near_dup, pack, quality, queries, scratch, shards, substring, topk

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return SPACE.findall(raw.lower() if lower else raw)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


# --- 1 sharding ---------------------------------------------------------------------------------


def test_shards(spark, documents):
    texts = [None, "", "", "é" * 3] + ["same"] * 40 + ["pair"] * 2 + [f"t{i}" for i in range(120)] + [f"g{i % 12}" for i in range(36)]
    out = shards.digest(spark, documents(texts, ["shard", "slot", "_id"]), 8).toPandas()
    assert len(out) == len(texts) and set(out.law) == {"rows"} and out.grown_shard.isna().all()
    counts = out.groupby("shard").size()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    by_id = out.set_index("doc_id")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert by_id.loc[i, "size"] == len(raw) + 1 and by_id.loc[i, "text_crc32"] == zlib.crc32(raw)
    spread = {}
    for i, t in enumerate(texts):
        spread.setdefault(t or "", set()).add(by_id.loc[i, "shard"])
    small = [len(spread[f"g{i}"]) for i in range(12)] + [len(spread["pair"])]
    assert sum(n > 1 for n in small) <= 1  # groups that fit stay whole
    assert len(spread["same"]) <= 6  # one that doesn't is split
    assert shards.digest(spark, documents([]), 8).count() == 0


def test_shards_of_repeated_and_null_ids(spark, documents):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, None), (3, "a"), (3, "a")] + [(None, "e")] * 5
    out = shards.digest(spark, documents(rows), 4).toPandas()
    assert Counter((None if math.isnan(k) else int(k), c) for k, c in zip(out.doc_id, out.text_crc32, strict=True)) == Counter((k, zlib.crc32((t or "").encode())) for k, t in rows)
    counts = out.groupby("shard").size()
    assert counts.sum() == len(rows) and counts.max() - counts.min() <= 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in out.groupby("shard"))


def cut(links, shard):
    return sum(shard[a] != shard[b] for a, b in links)


def test_propagation_cuts_few_edges(spark):
    """Against the even deal by hash and the best balanced placement by brute force over whole clusters."""
    r = random.Random(7)
    links, shard_size, n = [], 16, 64
    clusters = [list(range(i, i + 8)) for i in range(0, n, 8)]
    for c in clusters:
        links += [(a, b) for i, a in enumerate(c) for b in c[i + 1 :] if r.random() < 0.6]
    for a, b in zip(clusters[::2], clusters[1::2], strict=True):  # pairs of clusters that belong in one shard
        links += [(r.choice(a), r.choice(b)) for _ in range(2)]
    docs = spark.range(n).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame(links, "a long, b long")
    placed = {x["_id"]: x["shard"] for x in shards.shard(spark, docs, edges, "doc_id", n // shard_size, rounds=10).collect()}
    assert Counter(placed.values()) == dict.fromkeys(range(4), shard_size)
    by_hash = {i: i % 4 for i in range(n)}
    best = min(cut(links, {i: s for s, pair in enumerate(order) for c in pair for i in clusters[c]}) for order in pairings(list(range(8))))
    assert best == 0 and cut(links, placed) < 0.5 * cut(links, by_hash)


def pairings(left):
    """All ways to put clusters into shards of two."""
    if not left:
        yield []
        return
    for j in range(1, len(left)):
        for rest in pairings(left[1:j] + left[j + 1 :]):
            yield [(left[0], left[j]), *rest]


def test_links_are_trees_of_bounded_degree(spark, documents):
    d = documents(["a"] * 300 + ["b"] * 2 + ["c"]).withColumnRenamed("text", "g")
    pairs = [tuple(r) for r in shards.link_groups(d, "doc_id", "g", hubs=16).collect()]
    assert len(pairs) == 299 + 1
    degree = Counter(x for p in pairs for x in p)
    assert max(degree.values()) < 60


def test_rank_is_gapless(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 2 as o")
    out = scratch.rank(df, ["g"], [F.col("o")], F.col("id"), "n", 16).toPandas()
    for _, s in out.groupby("g"):
        s = s.sort_values("n")
        assert list(s.n) == list(range(len(s))) and list(s.o) == sorted(s.o)


# --- 2 extraction -------------------------------------------------------------------------------

ARTICLE = "<h1>The  title</h1><p>First, with a comma &amp; more\n text &#233;.<p>Second <b>bold</b><br>line.</p><ul><li>one<li>two</ul><p>Short.</p>"
WANT = "The title\nFirst, with a comma & more text é.\nSecond bold line.\none\ntwo\nShort."
PAGES = {
    "article": (f"<html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><!-- <p>no</p> --><div class=ad>Buy, buy, buy.</div><article>{ARTICLE}</article><footer>f</footer></body>", WANT),
    "divs": (f"<div id=header>Site</div><div id='sidebar'><p>Side, side, side and more of it here</p></div><div class='post-content'>{ARTICLE}<div class='share'>Share</div></div><div class=comments><p>I agree, really, with all, of it.</p></div>", WANT),
    "main": (f"<main><form><input><p>Subscribe, now, please</p></form>{ARTICLE}</main><aside><p>Related, links, here</p></aside>", WANT),
    "none": ("", ""),
    "bare": ("just text &lt;b&gt;", "just text <b>"),
    "markup only": ("<div><span></span></div><script>x</script>", ""),
    "unclosed": ("<p>One, two, three<p>Four <!-- open", "One, two, three\nFour"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert extract.main_text(page) == want


LONG = "".join(f"<p>{prose(i, 40)}, and more.</p>" for i in range(20))
SHORT = "<section><p>short closing paragraph</p></section>"
WHOLE = {
    "short section": (f"<div class=content><section>{LONG}</section>{SHORT}</div>", ["short closing paragraph"]),
    "deeper": (f"<div><div><section>{LONG}</section></div><div>{SHORT}</div></div>", ["short closing paragraph"]),
    "lists, tables, quotes and code": (f"<div><div>{LONG}</div><ul><li>one</ul><table><tr><td>cell</table><blockquote>said</blockquote><pre>x = 1</pre>bare</div>", ["one", "cell", "said", "x = 1", "bare"]),
    "has": (f"<div class='content has-sidebar'>{LONG}</div>", []),
    "with": (f"<div class='page-with-sidebar'>{LONG}</div><p>z</p>", ["z"]),
    "open": (f"<div class='hentry comments-open'>{LONG}</div>", []),
    "article inside": (f"<div id=sidebar-layout><article>{LONG}</article></div>", []),
    "form around": (f"<form id=aspnetForm><div>{LONG}</div></form>", []),
    "layout": (f"<div class=layout-sidebar-right><div>{LONG}</div></div>", []),
}
GONE = "<div class=menu-open><p>go, go, go</p></div><div><a href=/>Home page of it</a></div><div class='comments'><p>I agree, really</p></div><div hidden><p>not, seen</p></div>"


@pytest.mark.parametrize("name", WHOLE)
def test_main_text_is_whole(name):
    page, more = WHOLE[name]
    want = [f"{prose(i, 40)}, and more." for i in range(20)] + more
    assert extract.main_text(page).split("\n") == want
    assert extract.main_text(f"<body>{page}{GONE}</body>").split("\n") == want


def test_long_comments_go():
    page = f"<div class=post><p>Brief, but all of it.</p></div><div class=comments>{LONG}</div>"
    assert extract.main_text(page) == "Brief, but all of it."


def test_names_that_say_more_are_parts_of_the_best_container():
    more = "<div class='side-by-side'><p>Left, and right.</p></div><section id='alert-levels'><p>Red, and amber.</p></section><p>A <span class='notice-period'>month</span> ago.</p>"
    gone = "<div class='ad-slot-3'>Buy</div><div class='share-buttons'>Share</div><aside>x</aside><p class='comment-12'>I agree</p><p>B<span class=ad>uy</span></p>"
    want = "\n".join([*(f"{prose(i, 40)}, and more." for i in range(20)), "Left, and right.", "Red, and amber.", "A month ago.", "B"])
    for around in ("article", "main", "div class=content", "div"):
        page = f"<body><div class='side-note'><p>Sign, up</p></div><{around}>{LONG}{more}{gone}</{around.split()[0]}>"
        assert extract.main_text(page) == want, around


def test_scores_choose_among_articles_and_others():
    teasers = "".join(f"<article><a href=/{i}>Teaser {i}</a></article>" for i in range(5))
    assert extract.main_text(f"<div class=list>{teasers}</div><div class=content>{LONG}</div>") == "\n".join(f"{prose(i, 40)}, and more." for i in range(20))
    linked = "".join(f"<a href=/{i}><p>{prose(90 + i, 12)}, and on, and on, and on</p></a>" for i in range(9))  # blocks in links are links
    assert extract.main_text(f"<div><div>{linked}</div><div><p>Brief, but the text.</p></div></div>") == "Brief, but the text."
    twice = f"<div><p>{prose(1, 30)}</p></div>"
    assert extract.main_text(twice + twice) == f"{prose(1, 30)}\n{prose(1, 30)}"  # a tie: the other stands beside the first


def made_page(r):
    """A page and the text of its article, by construction."""
    want = []

    def block(tag, text, markup=None):
        want.append(" ".join(text.split()))
        return f"<{tag}>{markup or text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.7 else "")

    def words(n):
        return ", ".join(prose(r.random(), r.randint(3, 9)) for _ in range(n))

    def part(depth):
        kind = r.choice(["p", "p", "p", "h2", "ul", "quote", "bold", "section"]) if depth < 4 else "p"
        if kind == "ul":
            return "<ul>" + "".join(block("li", words(1)) for _ in range(r.randint(1, 4))) + "</ul>"
        if kind == "quote":
            return f"<blockquote>{block('p', words(2))}</blockquote>"
        if kind == "section":
            return f"<section class='{r.choice(['side-by-side', 'part', 'alert-levels', 'x'])}'>" + "".join(part(depth + 1) for _ in range(r.randint(1, 3))) + "</section>"
        if kind == "bold":
            a, b = words(1), words(2)
            return block("p", f"{a} {b}", f"<b class=x>{a}</b>\n &#32;{b}")
        return block("h2" if kind == "h2" else "p", words(1 if kind == "h2" else r.randint(1, 8)))

    inner = "".join(part(0) + r.choice(["", "", "<div class='ad'>Buy, now, cheap</div>", "<script>if (a < b) c('<p>')</script>", "<!-- <p>old</p> -->"]) for _ in range(r.randint(4, 12)))
    long_one = block("p", words(30))
    around = r.choice(["article", "main", "div class=post", "div", "section"])
    body = f"<{around}>{inner}{long_one}</{around.split()[0]}>"
    if r.random() < 0.3:
        body = f"<div class=wrapper><div>{body}</div></div>"
    head = r.choice(["", "<header><h1>Site, of sites</h1></header>"]) + "<nav><ul>" + "".join(f"<li><a href=/{i}>{prose(i, 3)}</a>" for i in range(6)) + "</ul></nav>"
    tail = r.choice(["", "<aside><p>Side, text, here</p></aside>"]) + r.choice(["", f"<div id=comments><p>{words(9)}</p></div>"]) + r.choice(["", "<form>Mail, please<input></form>"]) + "<footer>(c)</footer>"
    return f"<html><head><title>t</title></head><body>{head}{body}{tail}</body></html>", "\n".join(want)


@pytest.mark.parametrize("seed", range(150))
def test_made_pages(seed):
    page, want = made_page(random.Random(seed))
    assert extract.main_text(page) == want


@pytest.mark.parametrize("piece", ['<a "', '<a x="', "<p class='", "<svg/>", "<div></p>", "<script", "<b ", "<!--", "<p><li>", "</x>", "<td><p>", "<"])
def test_hostile_pages_take_linear_time(piece):
    start = time.process_time()
    extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 30


def test_extract_table(spark):
    rows = [(1, "u", PAGES["article"][0], "q"), (2, None, None, None), (2, None, None, None), (3, "v", "<p>" + "word, " * 50_000 + "</p>", "x"), (4, "d", "<div>" * 5000 + "deep, deep, text" + "</div>" * 5000, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.digest(extract.extract(df, "html")).collect()}
    assert got[1]["text"] == WANT and got[2]["text"] == "" and got[4]["text"] == "deep, deep, text"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[3]["n_chars"] == 50_000 * 6 - 1
    assert extract.extract(df.limit(0), "html").count() == 0


# --- 3 ledger -----------------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def base(text):
    found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n)
    return [sum(f[1] == i for f in found) for i in range(3)], hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest()


SECRETS = [
    None,
    "",
    "é password = 'abcdefghijkl' and Api_Key:short TOKEN=\"0123456789abcdef0123\"",
    "AKIA" + "A1" * 10 + " AKIASHORT",
    "0123456789abcdef" * 3 + "g" + "0123456789abcde",
    "ſecret=abcdefghijklmnop secretsecret: ABCDEFGHIJKL",
    "-----BEGIN RSA PRIVATE KEY-----",
    "x" * 100_000 + " passwd=" + "z" * 50,
] + ["token=aaaaaaaaaaaaaaaa"] * 30


def test_ledger(spark, documents, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = documents(SECRETS, ["found", "blob"])
    for _ in range(2):  # the second scan finds all in the ledger
        out = blob_ledger.digest(blob_ledger.scan(spark, docs, ["doc_id"], "text", ledger), "doc_id").collect()
        assert len(out) == len(SECRETS)
        for r in out:
            n, sha = base(SECRETS[r["doc_id"]])
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == n and r["base_sha256"] == sha
        assert spark.read.parquet(ledger).count() == len({s or "" for s in SECRETS})
    more = documents([(100, "token=aaaaaaaaaaaaaaaa"), (101, "new token=bbbbbbbbbbbbbbbb")])
    assert {r["doc_id"]: len(r["found"]) for r in blob_ledger.scan(spark, more, ["doc_id"], "text", ledger).collect()} == {100: 2, 101: 2}
    assert spark.read.parquet(ledger).count() == len({s or "" for s in SECRETS}) + 1
    blob_ledger.scan(spark, more, ["doc_id"], "text", ledger, {"hex": blob_ledger.RULES["hex"]}).count()  # another rule version
    assert spark.read.parquet(ledger).select("rules").distinct().count() == 2
    assert blob_ledger.scan(spark, documents([]), ["doc_id"], "text", ledger).count() == 0


def test_ledger_pairs_stored_twice_count_once(spark, documents, tmp_path):
    ledger = f"file://{tmp_path}/twice"
    docs = documents(SECRETS)
    blob_ledger.scan(spark, docs, ["doc_id"], "text", ledger).count()
    spark.read.parquet(ledger).write.mode("append").parquet(ledger)  # as two scans at once do
    out = blob_ledger.digest(blob_ledger.scan(spark, docs, ["doc_id"], "text", ledger), "doc_id").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(SECRETS)))
    assert all(r["base_sha256"] == base(SECRETS[r["doc_id"]])[1] for r in out)


def test_ledger_rules():
    scanners = blob_ledger.compiled(blob_ledger.RULES)
    secrets = {"github": "ghp_" + "a1B2" * 9, "google": "AIza" + "x_-9Z" * 7, "slack": "xoxb-123456789012-abcdefghij", "stripe": "sk_live_" + "4e" * 12, "jwt": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NSJ9.c2lnbmF0dXJl", "pem": "-----BEGIN EC PRIVATE KEY-----"}
    for kind, secret in secrets.items():
        text = f"é {secret} end"
        assert (kind, 2, 2 + len(secret)) in {(x["kind"], x["start"], x["end"]) for x in blob_ledger.spans_of(text, scanners)}
        assert not [x for x in blob_ledger.spans_of(f"{secret[:7]} end", scanners) if x["kind"] == kind]


def test_ledger_keeps_repeated_rows_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "token=aaaaaaaaaaaaaaaa"), ("p", 1, "token=aaaaaaaaaaaaaaaa"), ("p", 2, None), (None, 1, "x")], "path string, version long, text string")
    out = blob_ledger.scan(spark, df, ["path", "version"], "text", f"file://{tmp_path}/l2")
    assert sorted((str(r["path"]), r["version"], len(r["found"])) for r in out.collect()) == [("None", 1, 0), ("p", 1, 2), ("p", 1, 2), ("p", 2, 0)]


# --- 4 near duplicates --------------------------------------------------------------------------


def linked(texts, n):
    sets = []
    for t in texts:
        w = words(t, lower=True)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates(spark, documents):
    base_text, chain = prose(1, 300), prose(2, 120)
    texts = [None, "", "  \n", "one", "ONE", "one two three", "one two three four", base_text, base_text.upper()]
    texts += [edited(base_text, i, 0.01) for i in range(25)] + [edited(base_text, 50 + i, 0.03) for i in range(25)]
    for i in range(12):  # each near the one before
        chain = edited(chain, 100 + i, 0.02)
        texts.append(chain)
    texts += [prose(200, 60) + " " + prose(300 + i, 100) for i in range(15)]  # a shared passage
    texts += ["É" + prose(9, 40), "é" + prose(9, 40), prose(10, 30_000), prose(10, 30_000)]
    out = near_dup.link(spark, documents(texts, ["k", "n"]), "doc_id", "text", words=4, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == linked(texts, 4)
    assert near_dup.link(spark, documents([]), "doc_id", "text").count() == 0


def test_repeated_and_null_ids(spark, documents):
    t = prose(3, 50)
    out = near_dup.link(spark, documents([(5, t), (5, t), (9, t), (None, t)]), "doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [("5", "5"), ("5", "5"), ("9", "5"), ("None", "None")]


def test_keep_one(spark, documents):
    text, names = prose(1, 200), ["_own", "_linked", "k", "c", "___________"]
    rows = [(1, text), (2, "x " + text.split(" ", 1)[1]), (3, text), (4, prose(2, 100)), (5, None), (6, ""), (4, prose(2, 100)), (None, text), (None, "y"), (None, "y")]
    docs = documents(rows, names)
    out = near_dup.keep_one(spark, docs, "doc_id", "text")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "5", "6", "None", "None", "None"]
    assert all(r[n] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in got for n in names)
    assert near_dup.keep_one(spark, documents([]), "doc_id", "text").count() == 0


def test_tiles_of_large_buckets_find_what_small_ones_do(spark, monkeypatch, documents):
    texts = [edited(prose(1, 80), i, 0.045) for i in range(60)]
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    out = near_dup.link(spark, documents(texts), "doc_id", "text", words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == linked(texts, 4)


def test_posterior_keeps_true_pairs():
    rng = np.random.default_rng(1)
    needed = near_dup.thresholds(80, 1e-6)
    same = rng.random((20_000, near_dup.HASHES)) < 0.8
    assert len(near_dup.survivors(same.astype(np.uint16), np.ones_like(same, np.uint16), needed)) >= 19_999
    far = rng.random((20_000, near_dup.HASHES)) < 0.4
    assert len(near_dup.survivors(far.astype(np.uint16), np.ones_like(far, np.uint16), needed)) < 20


# --- 5 packing ----------------------------------------------------------------------------------

ODD = [None, "", "  ", "Plain words, here. It's <|endoftext|>x a.b. J̌ É́ 12.5 İstanbul. ﬁ ＡＢ <|ENDOFTEXT|>", "\x1c a\x85b c", "word " * 9000, "same text", "same text"]


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    out = pack.pack(documents(ODD, ["start", "ids"]), "doc_id", "text", path, 2).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    for i, t in enumerate(ODD):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        d = out[out.doc_id == i].sort_values("start")
        assert [x for ids in d.ids for x in ids] == want and set(d.doc_tokens) == {len(want)}
        assert list(d.start) == [0, *np.cumsum(d.length)[:-1]]
        for r in d.itertuples():
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    plain = pack.pack(documents(ODD), "doc_id", "text", path, 2, ids=False)
    assert plain.where("ids is not null").count() == 0 and plain.count() == len(out)
    assert pack.pack(documents([]), "doc_id", "text", path, 2).count() == 0


def test_every_code_point_is_tokenized_as_the_tokenizer_does():
    path = queries.tokenizer_path()
    w = pack.WordIds(path)
    code_points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0xE0000 <= c and not 0x30000 <= c < 0xE0000]
    for i in range(0, len(code_points), 20_000):
        texts = [f"a{chr(c)}b{chr(c)}. {chr(c)};, {chr(c)}" for c in code_points[i : i + 20_000]]
        want = w.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        got = w.ids(texts)
        assert [hex(code_points[i + j]) for j in range(len(texts)) if got[j].tolist() != want[j].ids] == []


def test_lengths():
    assert pack.lengths(9000, 4096) == [4096, 4096, 512, 256, 32, 8] and pack.lengths(1, 4096) == [1] and pack.lengths(4096, 4096) == [4096]


def test_word_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(pack, "MEMO_WORDS", 10)
    w = pack.WordIds(queries.tokenizer_path())
    texts = [prose(i, 40) for i in range(5)]
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w.ids([t])[0].tolist() for t in texts] == want


def test_each_unit_is_encoded_once(monkeypatch):
    """Case, and whatever punctuation follows, make no new unit; nor do later texts."""
    encoded = []

    class Watched(pack.WordIds):
        def encode(self, texts):
            encoded.extend(w for t in texts for w in t.split())
            return super().encode(texts)

    w = Watched(queries.tokenizer_path())
    texts = ["One TWO, été%%% one.%%% it's (two)", "Two... one### &&& ÉTÉ été", "", "one two &&& été,"]
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in w.ids(texts)] == want
        assert [x.tolist() for x in w.ids(texts[::-1])] == want[::-1]
    assert sorted(u for u in encoded) == sorted(["one", "two", "été", "ÉtÉ", "%%%", ".%%%", ",", "...", "###", "&&&", "it's", "(two)"])


def test_punctuation_behind_letters_is_tokenized_as_the_tokenizer_does():
    w = pack.WordIds(queries.tokenizer_path())
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"ab{x}{y} Éx{x}{y}{x} a{x}s{y} <|endoftext|>{x} ab<|endoftext|{y}" for x in marks for y in marks]
    assert [x.tolist() for x in w.ids(texts)] == [e.ids for e in w.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_batches_are_packed_together_up_to_a_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pack, "GROUP_BYTES", 100)
    sizes = [10, 20, 0, 300, 30, 30, 60]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array([i] * min(n, 1), pa.int64()), "t": pa.array([None if n == 20 else "x" * n] * min(n, 1), pa.string())}) for i, n in enumerate(sizes)]
    made = [(k.to_pylist(), [len(x) for x in t.to_pylist()]) for k, t in pack.together(iter(batches))]
    assert made == [([0, 1], [10, 0]), ([3], [300]), ([4, 5], [30, 30]), ([6], [60])]
    assert list(pack.together(iter([]))) == []


def test_packing_of_many_ids(spark, documents):
    """More ids than one output batch holds, in one batch of texts and in one text."""
    texts = ["a b " * 80_000 + "z " * i for i in range(12)] + ["c " * 1_100_000, "d"]
    docs = documents(texts).coalesce(1)
    out = pack.pack(docs, "doc_id", "text", queries.tokenizer_path(), 2).toPandas()
    w = pack.WordIds(queries.tokenizer_path())
    for i, t in enumerate(texts):
        d = out[out.doc_id == i].sort_values("start")
        want = [*w.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert list(d.start) == [0, *np.cumsum(d.length)[:-1]] and d.length.tolist() == pack.lengths(len(want), 4096)
        assert np.concatenate(d.ids.tolist()).tolist() == want and set(d.doc_tokens) == {len(want)}
        assert d.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in d.ids]
    assert out.sequence_id.is_unique


# --- 6 quality ----------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    known, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    scored = quality.score(spark, docs, quality.fit(spark, docs, known)).select("doc_id", "score")
    r = scored.join(held, "doc_id").toPandas()
    good = (r.quality == 1) & (r.toxic == 0)
    kept = r.score >= quality.KEEP
    assert (kept == good).mean() > 0.95 and kept[good].mean() > 0.97 and (~kept[~good]).mean() > 0.88


def test_classifier_cases(spark, documents):
    docs = documents([None, "", "fine words here"] + [prose(i, 30) for i in range(30)] + ["BUY!! NOW!! " * 20] * 12, ["score"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3, 30)] + [(i, 0, 0) for i in range(33, 44)] + [(None, 1, 0), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.score(spark, docs, quality.fit(spark, docs, labels)).collect()
    assert len(out) == 45 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in out)
    assert min(r["score"] for r in out if r["doc_id"] in range(3, 33)) > max(r["score"] for r in out if r["doc_id"] >= 33)
    none = labels.limit(0)
    assert quality.fit(spark, docs, none) is None and quality.score(spark, docs, None).where("score < 1").count() == 0
    assert quality.score(spark, documents([]), quality.fit(spark, docs, labels)).count() == 0


def test_sums_over_the_pool_are_those_of_all_its_rows(spark, documents):
    texts = [prose(i, 30) for i in range(60)] + ["BUY!! NOW!! " * (5 + i) for i in range(40)] + [None, "", prose(1, 30), prose(1, 30)]
    y = np.r_[np.ones(60), np.zeros(40)]
    langs, sources = ["en", None] * 52, ["s" if i < 60 else f"x{i % 3}" for i in range(104)]
    vocabulary = [b"buy", b"now", b"w1", b"w2", b"w3"]
    rows = quality.Rows.read(texts, langs, sources, quality.Index(vocabulary))
    assert quality.Rows.of(pa.RecordBatch.from_arrays(rows.arrays(), names=quality.Rows.NAMES), 5).content().tolist() == rows.content().tolist()
    table = spark.createDataFrame(list(zip(texts, langs, sources, strict=True)), "t string, lang string, source string").repartition(5)
    held = np.arange(100) % 4 == 0
    model = quality.CoTrained(vocabulary, *(quality.View(rows.take(slice(0, 100)), y, held, side) for side in (False, True)))
    got = quality.taught(spark, quality.features(table, vocabulary, []), model)
    p = [quality.sigmoid(v.logit(rows)) for v in (model.content, model.side)]
    sure = {(view, c): p[1 - view] >= quality.CONFIDENT if c else p[1 - view] <= 1 - quality.CONFIDENT for view in (0, 1) for c in (0, 1)}
    assert set(got) == {k for k, x in sure.items() if x.any()} and len(got) >= 3
    for (view, c), (n, total) in got.items():
        v = (model.content, model.side)[view]
        z = v.model.design(v.see(rows))[sure[view, c]].astype(float)
        q = 1 / (1 + np.exp(-np.clip(z @ v.model.w, -30, 30)))
        want = np.concatenate([(z.T @ (q - c))[None, :], (z * (q * (1 - q) + 1e-6)[:, None]).T @ z])
        assert n == sure[view, c].sum() and np.allclose(total, want, rtol=1e-3, atol=1e-3)


def test_repeated_rows_score_alike_and_pseudo_labels_have_no_cap(spark, documents):
    rows = [(i, prose(i, 30)) for i in range(40)] + [(100 + i, "BUY!! NOW!! " * 20) for i in range(12)] + [(None, prose(3, 30)), (3, prose(3, 30))]
    docs = documents(rows, ["k", "figures", "content_score", "lang_"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    out = quality.score(spark, docs, quality.fit(spark, docs, labels)).collect()
    assert len(out) == len(rows) and len({r["score"] for r in out if r["text"] == prose(3, 30)}) == 1
    assert all((r["score"] >= 0.5) == (r["text"][0] == "w") for r in out)


# --- 7 decontamination --------------------------------------------------------------------------


def distance(item, text):
    """Least edits between the item and any part of the text."""
    before = np.zeros(len(text) + 1, int)
    for c in item:
        now = np.empty_like(before)
        now[0] = before[0] + 1
        now[1:] = np.minimum(before[:-1] + (text != c), before[1:] + 1)
        for j in range(1, len(now)):
            now[j] = min(now[j], now[j - 1] + 1)
        before = now
    return before.min()


def test_bands_and_alignment_miss_nothing():
    r = random.Random(4)
    for _ in range(60):
        item = "".join(r.choice("abcdefgh ") for _ in range(r.randint(45, 140)))
        s = list(item)
        for _ in range(r.randint(0, 10)):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([[], ["x"], [s[i], "y"]])
        text = "qq ww " * r.randint(0, 4) + "".join(s) + " ee rr" * r.randint(0, 4)
        plain = decontam.normal(text)[0]
        for part in (10_000, decontam.PART, 50):
            parts = decontam.Parts([(1, item)], part=part)
            edits = [distance(x, plain) for x in parts.chars]
            found = decontam.find(text, parts)
            assert bool(found) == any(e <= k for e, k in zip(edits, parts.k, strict=True))
            assert not found or found[0][1] == min(e for e, k in zip(edits, parts.k, strict=True) if e <= k)


def test_excerpts_of_one_and_a_half_parts_hold_a_part():
    item = "".join(random.Random(8).choice("abcdefghij klmnopqrst") for _ in range(1000)).strip()
    parts = decontam.Parts([(1, item)])
    assert len(parts.chars) > 10 and len({len(x) for x in parts.chars}) == 1
    for i in range(0, len(item) - 240, 7):
        assert decontam.find("zz " + item[i : i + 240] + " zz", parts)


def test_short_items_occur_exactly_between_edges_of_words():
    items = [(1, "What is the capital of France? Paris."), (2, "a cat"), (3, "x"), (4, " \n "), (5, "É"), (6, "a  CAT")]
    parts = decontam.Parts(items)
    texts = {
        "Q: what is the  capital of\nFrance? PARIS. Next": {1}, "what is the capital of france? pari.": set(), "a cat": {2, 6}, "a cats": set(), "la cat": set(),
        "(A CAT)": {2, 6}, "x": {3}, "xx ax": set(), "ax x": {3}, "éa é": {5}, "": set(), " ": set(), "a cats and a cat": {2, 6},
    }
    for text, want in texts.items():
        low = " ".join(text.lower().split())
        brute = {i for i, t in items if t.strip() and re.search(rf"(?<![^\W_]){re.escape(' '.join(t.lower().split()))}(?![^\W_])" if t.strip()[-1].isalnum() else rf"(?<![^\W_]){re.escape(' '.join(t.lower().split()))}", low)}
        assert {h[0] for h in decontam.find(text, parts)} == want == brute, text


def test_decontamination(spark, documents, monkeypatch):
    a, b = "The quick brown fox jumps over the lazy dog and runs far away home.", prose(1, 60)
    items = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "short"), (5, "")], "item_id long, text string")
    texts = [None, "", "clean " * 30, "x " + a + " y", "x\n" + a.upper().replace(" ", "\n ") + "y", b, prose(2, 5000) + b + prose(3, 5000), a[:30], a.replace("quick", "quack")]
    hits = {3: 1, 4: 1, 5: 2, 6: 2, 8: 1, 9: 4, 10: 4}
    texts += ["cut it short.", "SHORT", "shorter", "a_short"]
    hits[12] = 4
    for size in (1024, 1):  # in one block and in many
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        docs = documents(texts, ["edits"])
        out = decontam.contained(spark, docs, items, "doc_id", "text", "item_id", "text").collect()
        assert {r["doc_id"]: r["item_id"] for r in out} == hits and len(out) == len(hits)
        kept = decontam.clean(spark, docs, items, "doc_id", "text", "item_id", "text")
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - set(hits)
    r = next(r for r in out if r["doc_id"] == 3)
    assert texts[3][r["start"] : r["end"]] == a and r["edits"] == 0
    rows = [(1, a), (1, a), (None, a), (None, "clean"), (2, "clean"), (2, "clean")]
    assert sorted(str(x["doc_id"]) for x in decontam.contained(spark, documents(rows), items, "doc_id", "text", "item_id", "text").collect()) == ["1", "1", "None"]
    assert sorted(str(x["doc_id"]) for x in decontam.clean(spark, documents(rows), items, "doc_id", "text", "item_id", "text").collect()) == ["2", "2", "None"]
    assert decontam.contained(spark, documents([]), items, "doc_id", "text", "item_id", "text").count() == 0
    assert decontam.contained(spark, docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert decontam.clean(spark, docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == len(texts)


# --- 8 substrings -------------------------------------------------------------------------------


def without_repeats(rows, n):
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits,groups", [(29, 100_000), (10, 0)])
def test_substrings(spark, documents, bits, groups):
    passage = prose(1, 60)
    texts = [None, "", "few words", passage, "a b " * 200, "a b " * 100, prose(4, 12), prose(4, 12), prose(5, 13), prose(5, 13)]
    texts += [f"{prose(10 + i, 30)} {passage}\n{prose(40 + i, 9)}" for i in range(6)] + [prose(7, 50)] * 9 + [prose(8, 20_000), edited(prose(8, 20_000), 1, 0.05)]
    rows = list(enumerate(texts)) + [(3, passage)]
    null = [(None, passage), (None, None)]
    assert sorted(str(tuple(r)[:3]) for r in substring.digest(substring.dedup(spark, documents([*null, (1, passage)]), "doc_id", "text", 13, bits, groups)).collect()) == ["(1, 60, 0)", "(None, 0, 0)", "(None, 60, 0)"]
    out = substring.digest(substring.dedup(spark, documents(rows, ["h", "at"]), "doc_id", "text", 13, bits, groups))
    assert sorted(tuple(r) for r in out.collect()) == without_repeats(rows, 13)
    assert substring.dedup(spark, documents([]), "doc_id", "text").count() == 0


# --- 9 lines ------------------------------------------------------------------------------------


def without_lines(rows, n):
    parts = {k: [x for x in (t or "").split("\n") if x.encode().strip()] for k, t in rows}
    first = {}
    for k in sorted(parts):
        h = [x.encode().strip() for x in parts[k]]
        for i in range(len(h) - n + 1):
            first.setdefault(tuple(h[i : i + n]), (k, i))
    out = {}
    for k, ls in parts.items():
        h = [x.encode().strip() for x in ls]
        gone = {j for i in range(len(h) - n + 1) if first[tuple(h[i : i + n])] < (k, i) for j in range(i, i + n)}
        out[k] = [x for j, x in enumerate(ls) if j not in gone]
    return out, parts


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3), (3, 4)])
def test_lines(spark, documents, gram, window):
    r = random.Random(3)
    pool = [f"line {i}" for i in range(30)]
    block = "\n".join(pool[:6])
    texts = [None, "", "\n\n", "one", block, "head\n" + block + "\n\ntail", block.replace("\n", "\n \n"), block + "\n" + block, block, "common\n" * 50]
    texts += ["\n".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = documents(rows, ["k", "_"])
    out = lines.dedup(spark, docs, "doc_id", "text", gram, window)
    assert out.columns == docs.columns
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    want, had = without_lines(rows, gram + window - 1)
    for k, t in rows:
        if had[k] and not want[k]:
            assert k not in got  # nothing is left
        else:
            assert [x for x in (got[k] or "").split("\n") if x.strip()] == want[k]
            assert want[k] != had[k] or got[k] == t
    assert lines.dedup(spark, documents([]), "doc_id", "text").count() == 0


def without_long_runs(rows, n, size):
    """Texts without the lines of runs of n lines, or of fewer that hold `size` words, that occur earlier."""
    parts = {k: [x.strip() for x in (t or "").split("\n") if x.strip()] for k, t in rows}
    runs = [(k, i, m, tuple(p[i : i + m])) for k, p in sorted(parts.items()) for i in range(len(p)) for m in range(1, n + 1) if i + m <= len(p)]
    runs = [x for x in runs if x[2] == n or sum(max(len(y.split()), len(y.encode()) // 8) for y in x[3]) >= size]
    first, gone = {}, set()
    for k, i, m, run in runs:
        if first.setdefault(run, (k, i)) < (k, i):
            gone.update((k, j) for j in range(i, i + m))
    return {k: [x for j, x in enumerate(p) if (k, j) not in gone] for k, p in parts.items()}, parts


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3)])
def test_long_repeats_of_few_lines_go(spark, documents, gram, window):
    r = random.Random(5)
    pool = [prose(i, n) for i, n in enumerate([1, 3, 6, 7, 12, 13, 14, 60, 90])] + ["汉" * 60]
    texts = [None, "", pool[8], "own head\n" + pool[8] + "\nown tail", pool[8], pool[5], pool[5], pool[4], pool[4], pool[2] + "\n" + pool[3], pool[2] + "\n\n" + pool[3], pool[9], "a\n" + pool[9], pool[7] + "\n" + pool[7]]
    texts += ["\n".join(r.choice([*pool, f"line {r.randrange(40)}"]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x["text"] for x in lines.dedup(spark, documents(rows), "doc_id", "text", gram, window).collect()}
    want, had = without_long_runs(rows, gram + window - 1, 13)
    assert got[3] == "own head\nown tail" and got[12] == "a" and got[8] == pool[4] and 10 not in got
    assert set(got) == {k for k in want if want[k] or not had[k]}
    assert all([x for x in (t or "").split("\n") if x.strip()] == want[k] for k, t in got.items())


def test_lines_of_repeated_and_null_ids(spark, documents):
    block = "\n".join(f"line {i}" for i in range(5))
    rows = [(None, block), (None, block), (4, block), (4, block), (9, "own\n" + block), (9, "own\n" + block), (None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup(spark, documents(rows), "doc_id", "text").collect())
    assert got == Counter({(None, block): 2, (None, None): 1, (4, block): 2, (9, "own"): 2})


def test_winnowing_guarantee():
    r = np.random.default_rng(2)
    for _ in range(50):
        g = r.integers(0, 20, r.integers(1, 60)).astype(np.uint64)
        at = lines.winnow(g, 4)
        assert all(any(i <= x < i + 4 for x in at) for i in range(len(g) - 3))


# --- 10 top-k -----------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.4, 8).astype(np.float32)], "x") for i in range(400)]
    rows += [(400 + i, rows[7][1], "y") for i in range(60)]  # ties
    rows += [(500, None, "z"), (501, [0.1, None] * 4, "z"), (502, [float("nan")] * 8, "z"), (503, [float("inf")] * 8, "z"), (504, [], "z"), (505, [0.5], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    v = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows if i < 500}
    monkeypatch.setattr(topk, "LIST_BLOCK", 64)
    for block in (8192, 3):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        out = topk.top_k(spark, df.repartition(3), df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).collect()
        got = {}
        for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        for q in range(0, 460, 50):
            every = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)
            assert got[q] == [(i, -s) for s, i in every[:5]]
        assert set(got) == set(range(0, 460, 50))
    few = df.where("vec_id < 3")
    assert topk.top_k(spark, few, few.where("vec_id = 0"), "vec_id", "embedding", 5).count() == 2
    assert topk.top_k(spark, few.limit(0), few, "vec_id", "embedding", 5).count() == 0
    assert topk.top_k(spark, few, few.limit(0), "vec_id", "embedding", 5).count() == 0


def by_brute_force(rows, k, scale=256):
    """{query: [(id, score)]} for ids divisible by 50; vectors meet their own length only."""
    v = [(i, [min(max(math.floor(scale * x), -(2**63)), 2**63 - 1) for x in e]) for i, e in rows if i is not None]
    out = {}
    for q, a in v:
        if q % 50 == 0:
            every = sorted((-min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1), i) for i, b in v if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in every[:k]]
    return {q: x for q, x in out.items() if x}


def answers(df, k):
    got = {}
    for x in sorted(topk.top_k(df.sparkSession, df, df.where("vec_id % 50 = 0"), "vec_id", "v", k).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    return got


def test_top_k_of_several_lengths_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_BLOCK", 8)
    monkeypatch.setattr(topk, "LIST_BLOCK", 32)
    r = np.random.default_rng(5)
    two = [(i, [float(x) for x in r.normal(0, 1, 2 if i % 3 else 1)]) for i in range(200)] + [(None, [1.0, 2.0])]
    huge = [(1000 + i, [float(x) for x in r.normal(0, 1e8, 5)]) for i in range(120)]
    beyond = [(2000 + i, [float(x) for x in r.normal(0, 3e15, 7)]) for i in range(60)]
    same = [(3000 + i, [1e8 + 1, 1.0 + i % 2 / 256, 1e-3, 0.0]) for i in range(60)]  # sums that differ in the last bit
    rows = two + huge + beyond + same
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, v array<double>, score int").repartition(3)
    assert answers(df, 5) == by_brute_force(rows, 5)
    assert answers(df.where("vec_id in (0, 1, 2, 3)"), 5) == by_brute_force([x for x in rows if x[0] in (0, 1, 2, 3)], 5)


def test_reading_stops_before_the_lists_end():
    """On vectors with few large components most lists are left unread, and results are those of full products."""
    r = np.random.default_rng(6)
    x = np.floor(256 * r.standard_t(1.5, (4096, 16))).astype(np.int64)
    lists, q = topk.Lists(np.arange(4096), x), x[:40]
    score = q @ x.T
    score[np.arange(40), np.arange(40)] = -(1 << 62)
    floor = np.sort(score, axis=1)[:, -5].astype(float)
    depths = []
    for i in range(40):
        at = topk.read_on(lists, q[i].astype(float), np.flatnonzero(np.arange(4096) != i), 64, 5, floor[i], 0.0)
        assert set(np.argsort(-score[i], kind="stable")[:5]) <= set(at.tolist())
        depths.append(len(at))
    assert np.median(depths) <= 8
    qs, ids, s = topk.best(lists, q, np.arange(40), 5, np.full(40, -np.inf))
    for i in range(40):
        want = sorted((-int(score[i, j]), j) for j in range(4096) if j != i)[:5]
        assert sorted((-int(b), int(a)) for a, b in zip(ids[qs == i], s[qs == i], strict=True)) == want
