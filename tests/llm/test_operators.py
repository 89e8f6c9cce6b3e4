"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "é", "ß", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    passage = text(70)
    rows = [text(rng.randint(1, 200)) for _ in range(80)]
    rows += [rows[3], rows[3], rows[5] + " more", f"{text(20)} {passage} {text(30)}", f"{text(5)} {passage}", passage, None, "", " ", "\n\n a  b\t\n", "x", "😀 é́", "a" * 30_000, "w " * 3000]
    rows += ["x <|endoftext|> y", "<|endoftext|><|endoftext|>\n a<|endoftext|>", "a b \u2028", "a b \u0085", "a \u2029"]
    rows += ["Mail a.b@c.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.25.", "IBAN GB82 WEST 1234 5698 7654 32"]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], SCHEMA)


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_packing(docs):
    from tokenizers import Tokenizer

    from facetflow.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = pack(docs, path, windows=4).collect()
    sequences: dict = {}
    of: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of.setdefault(r["doc_id"], []).append((r["start"], ids))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    for i, t in texts(docs).items():
        assert np.concatenate([x for _, x in sorted(of[i], key=lambda x: x[0])]).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_bpe_matches_the_library(docs):
    import tiktoken

    from facetflow.llm.bpe import decode, encode, read_ranks

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    want = texts(docs)
    rows = decode(encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(want[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == want[r["doc_id"]] and r["well_formed"]


def test_bpe_does_not_depend_on_the_table(spark, docs):
    import tiktoken

    from facetflow.llm.bpe import Transducer, read_ranks, round_trip

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pieces = ["".join(rng.choice(["th", "er", "a", "aa", "é", "ß", "ing", "日本", "😀", "1", " ", "--"]) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    pieces += ["a" * 700, "ab" * 400, " " * 300, *(a + b for a in "aé日" for b in "bß本")]
    for machine in (Transducer(ranks, 0), Transducer(ranks, 300), Transducer(ranks)):
        assert all(machine.encode(p.encode()) == library.encode_ordinary(p) for p in pieces)
    want = texts(docs)
    whole = tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in round_trip(docs, path, public_tokenizers.PATTERN).collect():
        ids = whole.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_utf8_machine_is_incremental():
    from facetflow.llm.bpe import Utf8Machine

    for data in ("a😀é".encode(), b"\xff\xc3", b"\xe2\x82", b"\xed\xa0\x80x", "日本".encode()):
        machine = Utf8Machine()
        assert "".join(machine.feed(bytes([b])) for b in data) + machine.finish() == data.decode("utf-8", "replace")


def test_pii_patterns(docs, spark):
    from facetflow.llm import pii

    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    rng = random.Random(2)
    for t in [*texts(docs).values(), *("".join(rng.choice("aB@.-+1 9(é4") for _ in range(rng.randint(0, 40))) for _ in range(3000))]:
        want = sorted(((m.start(), list(base).index(k), k, m.end()) for k, p in base.items() for m in re.finditer(p, t) if good[k](m[0])), key=lambda x: x[:2])
        assert [(s, k, e) for s, _, k, e in want] == [(s, k, e) for k, s, e, _ in pii.find(t) if k in base]
    assert [x[0] for x in pii.find("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"] and not pii.find("IBAN GB82 WEST 1234 5698 7654 33")
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[86] is None and "[EMAIL]" in redacted[99] and "@" not in redacted[99]


def test_iban_before_other_words():
    from facetflow.llm import pii

    for text, iban in (("IBAN GB82 WEST 1234 5698 7654 32 BIC NWBKGB2L", "GB82 WEST 1234 5698 7654 32"), ("IBAN DE89 3704 0044 0532 0130 00 2024", "DE89 3704 0044 0532 0130 00"), ("REF XX12 3456 GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32")):
        assert [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"] == [iban]
        assert iban not in pii.masked(text)
    assert "iban" not in [x[0] for x in pii.find("IBAN GB82 WEST 1234 5698 7654 33 BIC NWBKGB2L")]


def test_pii_scores_and_context():
    from facetflow.llm import pii

    iban = "GB82 WEST 1234 5698 7654 32"
    score = lambda text, kind, **kw: [s for k, _, _, s in pii.find(text, **kw) if k == kind]
    assert (score(f"account {iban}", "iban"), score(f"x {iban}", "iban"), score(f"model serial part {iban}", "iban")) == ([1.0], [0.75], [])
    assert score("ssn 123-45-6789", "ssn") == [0.7] and not score("x 123-45-6789", "ssn") and not score("ssn order 123-45-6789", "ssn")
    assert score("host 10.0.0.25", "ip") == [1.0] and score("version 10.0.0.25", "ip") == [0.4] and not score("version 10.0.0.25", "ip", base_threshold=0.5)


def warc_brute(rows, min_payload=0):
    """page -> bytes, digest, type, refers_to; rows are distinct in page."""
    import base64

    payload = {p: (h or "").encode() for p, _, h in rows}
    out = {}
    for p, x in payload.items():
        best = max(q for q in payload if payload[q] == x)
        revisit = len(x) >= min_payload and best != p
        out[p] = (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if revisit else "response", best if revisit else None)
    return out


def test_warc_revisits(spark, tmp_path):
    import duckdb

    from facetflow.llm import warc

    schema = "page_id long, url string, html string, `a.b` string, HTML string"
    rng = random.Random(3)
    rows = [(1, "u1", "<p>é</p>"), (2, "u2", "x\r\n\r\ny"), (3, "u3", "<p>é</p>"), (4, None, None), (5, "u5", ""), (7, "u7", "<p>é</p>"), (8, "big", "é" * 6_000_000), (9, "big", "é" * 6_000_000)]
    rows += [(k, f"u{k}", rng.choice(["", "a", "b" * 50, f"own {k}"])) for k in range(20, 120)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3)
    for n, (least, a_file) in enumerate(((0, 2000), (1, 7))):
        warc.write_pages(pages, f"{tmp_path}/raw{n}", a_file)
        warc.resolve(spark, f"{tmp_path}/raw{n}", f"{tmp_path}/out{n}", least, a_file)
        got = {r["page_id"]: r for r in warc.read_records(spark, f"{tmp_path}/out{n}").collect()}
        want = warc_brute(rows, least)
        assert {k: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for k, r in got.items()} == want
        text = {p: (h or "").encode() for p, _, h in rows}
        assert all((bytes(r["payload"]) == text[k]) if r["record_type"] == "response" else r["payload"] is None for k, r in got.items())
        sizes = [r["n"] for r in spark.read.format("binaryFile").load(f"{tmp_path}/out{n}/*.gz").selectExpr("1 as n").collect()]
        assert len(sizes) >= len(rows) / a_file
    assert sum(v[2] == "revisit" for v in want.values()) > 30
    twice = [(1, "u", "x"), (1, "u", "x"), (0, "u", "x"), (None, "u", "x")]
    warc.write_pages(spark.createDataFrame(twice, "page_id long, url string, html string"), f"{tmp_path}/raw")
    warc.resolve(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, f"{tmp_path}/out").collect()), key=str) == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1)]
    warc.write_pages(pages.limit(0), f"{tmp_path}/none")
    warc.resolve(spark, f"{tmp_path}/none", f"{tmp_path}/none2")
    assert warc.read_records(spark, f"{tmp_path}/none2").collect() == []
    small = [r for r in rows if r[0] not in (8, 9)]
    db = duckdb.connect()
    db.register("pages", spark.createDataFrame(small, "page_id long, url string, html string").toArrow())
    assert {r[0]: r[1:] for r in db.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.SQL})").fetchall()} == warc_brute(small)


def removed(rows):
    """(doc_id, text) -> n_words, n_removed, words that stay."""
    seen: dict = {}
    out = {}
    for i, t in sorted(rows):
        words = t.encode().split()
        gone = set()
        for k in range(len(words) - 49):
            if seen.setdefault(tuple(words[k : k + 50]), i) < i:
                gone |= set(range(k, k + 50))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


def test_substring_dedup(docs):
    import duckdb

    from facetflow.llm import substring_dedup

    want = removed(texts(docs).items())
    assert sum(n for _, n, _ in want.values()) > 100
    count = lambda: {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.counted(docs).collect()}
    assert count() == want
    got, before = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (substring_dedup.clean(docs), docs))
    assert got == {i: want[i][2] if want[i][1] else before[i] for i in before}
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    rows = db.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({substring_dedup.SQL})").fetchall()
    assert {r[0]: r[1:] for r in rows} == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}


def test_substring_dedup_compares_words(spark, docs, monkeypatch):
    """With hashes that meet by chance, comparing the words at the source finds it, and another seed is taken."""
    from facetflow.llm import substring_dedup

    true = substring_dedup.word_hashes

    def poor(lists, seed=0):
        return true(lists, seed) if seed else true([[b"same" for _ in words] for words in lists], 0)

    monkeypatch.setattr(substring_dedup, "_paths", _poor_paths(substring_dedup._paths, poor))
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.counted(docs).collect()} == removed(texts(docs).items())
    marks = [{"start": s, "n": n, "doc": d, "hash": 7, "at": a} for s, n, d, a in ((3, 5, 1, 103), (8, 2, 1, 108), (20, 1, 1, 120), (10, 1, 2, 50), (5, 1, 1, 105))]
    assert sorted(substring_dedup.compact(marks)) == [[1, 7, 103, 3, 7], [1, 7, 120, 20, 1], [2, 7, 50, 10, 1]]


def _poor_paths(paths, hashes):
    """_paths() as a function of its own, so that workers get it by value, with other hashes of words."""
    import types

    own = types.FunctionType(paths.__code__, paths.__globals__ | {"word_hashes": hashes, "__name__": "__main__"}, "_paths")
    own.__module__ = "__main__"
    return own


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_simhash(spark, docs, bucket):
    import xxhash

    from facetflow.llm.simhash import fingerprint, near_duplicates

    t = "A b C d e"
    shingles = [b"a b c", b"b c d", b"c d e"]
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    assert fingerprint(t) == sum(1 << k for k, n in enumerate(bits) if 2 * n > 3)
    # Long texts with a word changed, whose fingerprints differ by few bits.
    rng = random.Random(8)
    long = [[f"w{rng.randrange(300)}" for _ in range(400)] for _ in range(3)]
    near = [(500 + 40 * k + j, " ".join(words[: 9 * j] + ["new"] + words[9 * j + 1 :])) for k, words in enumerate(long) for j in range(40)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    none = rows.where("doc_id in (3, 86)").selectExpr("cast(null as long) as doc_id", "text")
    got = near_duplicates(rows.union(none), bucket=bucket).collect()
    assert [(r["component_id"]) for r in got if r["doc_id"] is None] == [None, None]
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got if r["doc_id"] is not None}
    assert sum((fps[a] ^ fps[b]).bit_count() in (1, 2) for a in fps for b in fps if a < b) > 100
    component = {i: i for i in fps}
    for _ in fps:
        changed = {i: min(component[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if changed == component:
            break
        component = changed
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == component


def test_pipeline_near_duplicates(spark, docs, monkeypatch):
    """Against brute force over five-word shingles, through the stage itself."""
    from itertools import combinations

    from corpus_pipeline import STAGES
    from facetflow.llm import near_copies

    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k in (2, 4, 7, 11, 13, 20):  # changed words, far enough apart: beyond two bits of a fingerprint
        for changes in range(1, 9):
            words = rows[k][1].split()
            for at in rng.sample(range(len(words)), min(changes, len(words))):
                words[at] = f"new{at}"
            rows.append((1000 + 10 * k + changes, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    rows += [(2000 + k, " ".join(chain[2 * k : 2 * k + 40])) for k in range(8)]  # each near the next, the ends apart
    # Texts that share many bands, but are less alike than 0.8 to each other, though each is near to the first.
    rows += [(2100 + k, " ".join(f"m{i}" if i // 6 != k else f"n{k}x{i}" for i in range(120))) for k in range(20)]
    rows += [(3000, rows[2][1].upper()), (3001, "x"), (3001, "another text under the same id as x, which is a copy")]
    shingles = {}
    for i, t in enumerate(rows):
        words = (t[1] or "").encode().lower().split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]) and root[a] != root[b]:
            root = [root[a] if r == root[b] else r for r in root]
    want = sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = dict(STAGES)["simhash_near_dedup"](spark, frame, "").collect()
    assert sorted(r["doc_id"] for r in got) == want
    monkeypatch.setattr(near_copies, "BLOCK", 3)  # blocks of bands
    monkeypatch.setattr(near_copies, "FOLLOWERS", 3)  # parts of leaders
    nulls = spark.createDataFrame([(None, "x", "en", "s", 1), (None, "x", "en", "s", 1)], SCHEMA)
    got = near_copies.first_of_groups(frame.union(frame).union(nulls)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want and len(got) == len(want) + 2


def linked_by_cosine(v):
    """Links and least component of unit vectors, by brute force."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, True)
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            return link.sum(1) - 1, label
        label = new


def test_embedding_dedup(spark):
    from facetflow.llm.embedding_dedup import MultiIndex, near_duplicates, unit

    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 12))
    side = rng.normal(size=(300, 12))
    side -= (side * unit(base[:300])).sum(1, keepdims=True) * unit(base[:300])
    cos = rng.uniform(0.95, 0.97, (300, 1))
    v = np.concatenate([base, cos * unit(base[:300]) + np.sqrt(1 - cos**2) * unit(side), base[:5], base[:3] * 7, base[9] + 0.02 * rng.normal(size=(60, 12))]).astype(np.float32)
    links, label = linked_by_cosine(v.astype(float))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    other = [(2000 + k, x) for k, x in enumerate(([1.0, 2.0], [2.0, 4.0], [1.0, 0.0], [3.0]))]
    odd = [(3000 + k, x) for k, x in enumerate((None, [0.0] * 12, [float("nan")] * 12, [1.0] * 11 + [None], [float("inf")] + [1.0] * 11, []))]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows + other + odd], "vec_id long, embedding array<float>, `a.b` string, EMBEDDING string").repartition(3)
    # One cell; cells of one level and of two, cut into blocks.
    for how in ({}, {"block": 32, "per_cell": 8, "recall": 1.0}, {"block": 32, "per_cell": 8, "centroids": 3, "recall": 1.0}):
        got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicates(frame, **how).collect()}
        assert [got[i][0] for i in range(len(v))] == links.tolist() and [got[i][1] for i in range(len(v))] == label.tolist()
        assert [got[2000 + k] for k in range(4)] == [(1, 2000, True), (1, 2000, False), (0, 2002, True), (0, 2003, True)]
        assert all(got[3000 + k] == (0, 3000 + k, True) for k in range(len(odd)))
    found = near_duplicates(frame, block=32, per_cell=8).where("vec_id < 2000").agg({"n_links": "sum"}).first()[0]
    assert 0.9 * links.sum() <= found <= links.sum()
    index = MultiIndex(unit(v), len(v), recall=1.0, per_cell=8, most=3)
    assert len(np.unique(index.cells(unit(v)))) > 40
    # Each cost is a lower bound of the squared distance, and the traversal visits all cells within the bound, cheapest first.
    u, cells = unit(v), index.cells(unit(v))
    for k, seen in zip(range(0, 40), index.visits(u[:40]), strict=True):
        cost = index._cost(np.repeat(u[k : k + 1], len(u), 0), cells)
        assert (cost <= ((u - u[k]) ** 2).sum(1) + 1e-5).all()
        assert set(cells[cost <= index.bound].tolist()) <= set(seen) and seen[0] == cells[k]
    # Ids that repeat or are null name vectors all the same.
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (5, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_duplicates(twice).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (5, 1, 1, False), (None, 0, None, True), (None, 1, 1, False)]


def test_preferences(spark):
    import duckdb

    from facetflow.llm import preferences

    S, U, A = ("system", "s"), ("user", "u"), ("assistant", "a")
    talks = {0: [S, U, A], 1: [S, U, ("assistant", "b"), U, A], 2: [U, A], 3: [U, A], 4: [("user", "x"), A], 5: [U, A], 6: [U, A], 9: [(None, None), A], 10: [("", ""), A], 11: [(None, None), ("assistant", "<|im_end|>é😀")], 14: [U], 15: [U, A], 12: [U], 13: [U, A]}
    rows = [(c, k, r, t, "clash") for c, turns in talks.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "clash"), (6, 0, "user", "u", "clash"), (6, None, "user", "first", "clash")]
    rows += [(14, 1, "", "b", "clash"), (14, 1, None, "a", "clash")]  # nulls count as empty in the order, too
    talks[14] = [U, ("", "a"), ("", "b")]
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "conv_id long, turn int, role string, text string, prompt string")
    show = lambda turns: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
    talks[6] = [("user", "first"), U, U, A]
    got = {r["pair_id"]: r for r in preferences.format_pairs(preferences.by_neighbours(frame)).collect()}
    assert sorted(got) == sorted({c // 2 for c in talks})
    for k, r in got.items():
        a, b = ([(x or "", y or "") for x, y in talks.get(2 * k + i, [])] for i in (0, 1))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert (r["n_prompt_turns"], r["n_chosen_turns"], r["n_rejected_turns"], r["prompt"]) == (n, len(a) - n, len(b) - n, show(a[:n]))
        for side, turns in (("chosen", a), ("rejected", b)):
            if not turns:
                assert r[side] is None
                continue
            assert "".join(s["text"] for s in r[side]) == show(turns[n:])
            assert [s["text"] for s in r[side] if s["trained"]] == [f"{t}<|im_end|>" for role, t in turns[n:] if role == "assistant"]
        assert r["usable"] == all(any(role == "assistant" for role, _ in turns[n:]) for turns in (a, b))
    read = preferences.table
    try:
        preferences.table = lambda *_: frame
        digests = sorted(tuple(r) for r in preferences.op3_preferences(spark, "").collect())
    finally:
        preferences.table = read
    db = duckdb.connect()
    db.register("conversations", frame.toArrow())
    assert sorted(db.sql(preferences.SQL).fetchall(), key=lambda r: r[0]) == digests
    assert preferences.format_pairs(preferences.by_neighbours(frame.limit(0))).collect() == []


def test_quality_rules(spark, docs):
    from facetflow.llm.quality_rules import judge, keep, statistics

    for t in texts(docs).values():
        words = t.encode().split()
        count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) for j in range(5) if count[tuple(words[k : k + 5])] > 1}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert statistics(t)[0] == (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = judge(docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert sorted(r["doc_id"] for r in keep(docs, labels).collect()) == sorted(r["doc_id"] for r in rows if r["kept"])


def path_length(tree, row):
    """Of one row, node by node."""
    feature, value, left, right, path = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] if row[feature[node]] < value[node] else right[node]
    return path[node]


def test_forest_against_plain_python(spark):
    from facetflow.llm import quality_rules as Q

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    forest, use, threshold = Q.fit(docs.union(docs.limit(20)), labels.union(labels.limit(20)))
    assert forest is not None and 0 < threshold < 1
    usual = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    want = {}
    for r in docs.collect():
        counts, features = Q.statistics(r["text"] or "")
        row = [features[k] for k in use]
        anomaly = 2 ** -(sum(path_length(t, row) for t in forest.trees) / len(forest.trees) / usual(forest.sample))
        want[r["doc_id"]] = (anomaly, not (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and anomaly < threshold)
    got = {r["doc_id"]: r for r in Q.judge(docs.union(docs.limit(20)), labels.union(labels.limit(20))).collect()}
    assert all(abs(got[i]["anomaly"] - a) < 1e-9 and got[i]["kept"] == k for i, (a, k) in want.items())
    # The threshold, by trying all of them.
    rng = np.random.default_rng(4)
    scores, good = rng.integers(0, 30, 400) / 30, rng.random(400) < 0.8
    scores[~good] += 0.3
    found, worth = Q.calibrate(scores, good, 0.02)
    tried = [((scores[~good] >= s).mean() - (scores[good] >= s).mean(), s) for s in np.unique(scores) if (scores[good] >= s).mean() <= 0.02]
    assert abs(worth - max(tried)[0]) < 1e-9 and abs((scores[~good] >= found).mean() - (scores[good] >= found).mean() - worth) < 1e-9
    assert Q.calibrate(np.zeros(10), np.ones(10, bool)) == (float("inf"), 0.0)


def test_forest_learns_from_all_labelled_rows(spark):
    """All junk has greater hashes of its doc_id than the first 12,000 labelled rows."""
    from pyspark.sql import functions as F

    from facetflow.llm import quality_rules as Q

    ids = [r["id"] for r in spark.range(12_600).orderBy(F.xxhash64("id"), "id").collect()]
    junk = set(ids[-400:])
    rng = np.random.default_rng(3)
    text = {i: " ".join(f"w{k}" for k in rng.integers(0, 9000, rng.integers(12, 30))) + (" ### $$$ !!! ???" if i in junk else ".") for i in ids}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in junk)) for i in ids], "doc_id long, quality int")
    kept = {r["doc_id"] for r in Q.judge(docs, labels).where("kept").collect()}
    assert len(kept & junk) < 0.05 * len(junk) and len(kept) >= 0.99 * (len(ids) - len(junk))


def test_all_labelled_rows_take_part(spark):
    """Each row of one half is in a tree, each tree has its share, and the threshold is that of plain numpy on the whole other half."""
    from pyspark.sql import functions as F

    from facetflow.llm import quality_rules as Q

    for n in (1, 3, 300, Q.TREES * Q.SAMPLE + 450):
        h = F.xxhash64("id")
        rows = spark.range(n).select(F.col("id").alias("doc_id"), h.alias("hash"), F.pmod(h, F.lit(Q.RANGES)).cast("int").alias("range"))
        dealt = [tuple(r) for r in Q._dealt(rows, {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}).select("tree", "doc_id").collect()]
        assert len(dealt) == len(set(dealt)) and {i for _, i in dealt} == set(range(n))
        size = Counter(t for t, _ in dealt)
        assert max(size.values()) == Q._share(n) and (n > Q.TREES * Q.SAMPLE or set(size.values()) == {min(n, Q.SAMPLE)} and len(size) == Q.TREES)
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    features = {r["doc_id"]: Q.statistics(r["text"] or "") for r in docs.collect() if r["doc_id"] in quality}
    features = {i: f for i, (c, f) in features.items() if not Q.base_failed(c[0], c[4])}
    rows = Q._labelled(docs, labels)
    got = rows.collect()
    assert {r["doc_id"]: (tuple(r["features"]), r["good"]) for r in got} == {i: (f, quality[i] == 1) for i, f in features.items()}
    assert 0.4 < sum(r["grown"] for r in got) / len(got) < 0.6
    counts = Counter(r["range"] for r in got if r["grown"])
    forests = Q._forests(rows.where("grown"), counts)
    held = [r for r in got if not r["grown"]]
    table, good = np.array([r["features"] for r in held]), np.array([r["good"] for r in held])
    want = [Q.calibrate(f.score(table[:, [Q.FEATURES.index(c) for c in family]]), good) for f, family in zip(forests, Q.FAMILIES, strict=True)]
    assert Q._thresholds(rows.where("not grown"), forests) == want
    forest, use, threshold = Q.fit(docs, labels)
    k = max(range(len(want)), key=lambda k: want[k][1])
    assert threshold == want[k][0] and use == [Q.FEATURES.index(c) for c in Q.FAMILIES[k]]
    assert all(all(np.array_equal(a, b) for a, b in zip(x, y, strict=True)) for x, y in zip(forest.trees, forests[k].trees, strict=True))


def test_trained_models(spark):
    from facetflow.llm.quality_classifier import op2_quality_classifier
    from facetflow.llm.quality_rules import op10_quality_rules

    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = op2_quality_classifier(spark, folder).collect()
    assert len(scored) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(b == 0 for a, b in held if a == 0)
    judged = {r["doc_id"]: r for r in op10_quality_rules(spark, folder).collect()}
    good = [judged[i]["kept"] for i, q in labels.items() if q == 1 and not judged[i]["base_failed"]]
    assert sum(good) >= 0.98 * len(good)


def test_classifier_learns_from_labels_only(spark):
    """Repeated words, marks and bars are told by learned rows; with labels turned around, so are the scores; without a table there is nothing."""
    from facetflow.llm import quality_classifier as Q

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    taught, held = ([r for r in rows if (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == flag] for flag in (False, True))
    y = np.array([r["quality"] for r in held])
    for turned in (0, 1):
        model = Q.train([r["text"] for r in taught], np.array([r["quality"] ^ turned for r in taught]))
        scores = model.scores([r["text"] for r in held])
        assert ((scores >= 0.5) == (y ^ turned)).mean() > 0.95
    model.weights[:] = 0
    assert len(set(Q.Model(model.weights, model.bias, model.prior).scores([r["text"] for r in held if r["text"].strip()]).tolist())) == 1
    # One by one as in a batch, and whatever the words remembered; long words count all of their n-grams.
    model = Q.train([r["text"] for r in taught], np.array([r["quality"] for r in taught]))
    some = [r["text"] for r in held[:20]] + ["", " ", "ab" * 200, "w " * 300]
    assert np.allclose(model.scores(some), [Q.Model(model.weights, model.bias, model.prior).scores([t])[0] for t in some])
    assert len(Q.subwords(b"a" * 500)) == 1 + 500 + 499

    def slow(text):
        words = text.encode().split()
        if not words:
            return model.prior
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        every = np.concatenate([*(Q.subwords(w) for w in words), Q.pairs(h)])
        return 1 / (1 + np.exp(-(model.weights[every].mean() + model.bias)))

    assert np.allclose(model.scores(some), [slow(t) for t in some])
    known = {r["doc_id"]: r for r in Q.classify(docs.limit(3).selectExpr("doc_id", "cast(null as string) as text"), model).collect()}
    assert len(known) == 3 and all(r["score"] == model.prior for r in known.values())
    one = Q.fit(docs.union(docs), labels.where("quality = 1"))
    assert {r["predicted"] for r in Q.classify(docs.limit(5), one).collect()} == {1}
    few = Q.fit(docs.union(docs), labels.union(labels), max_train_docs=50, max_train_bytes=20_000)
    assert Q.classify(docs.limit(5), few).count() == 5


def test_decoder_emits_what_the_machine_does(spark, docs, monkeypatch):
    from facetflow.llm.bpe import StreamDecoder, Utf8Machine, read_ranks

    tokens = {v: k for k, v in read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).items()}
    byte = {v: k for k, v in tokens.items() if len(v) == 1}
    decoder = StreamDecoder(tokens)
    for data in ("a😀é日本".encode(), b"\xff\xc3", b"\xe2\x82", b"\xed\xa0\x80x", b"ok\xc3\xa9\xf0\x9f\x98"):
        ids = np.array([byte[data[k : k + 1]] for k in range(len(data))])
        for _ in range(2):  # also from remembered moves
            out, good = decoder(ids)
            assert out == data and good == (data.decode("utf-8", "ignore").encode() == data)
    plain = Utf8Machine.run
    monkeypatch.setattr(Utf8Machine, "run", classmethod(lambda cls, state, kept, data: (*plain(state, kept, data)[:2], plain(state, kept, data)[2].upper(), plain(state, kept, data)[3])))
    assert StreamDecoder(tokens)(np.array([byte[b"a"], byte[b"b"]]))[0] == b"AB"


def test_repeated_rows_and_odd_names(spark, docs):
    """Rows that repeat, null ids, and columns whose names differ in case only, hold dots, or are used inside."""
    from facetflow.llm import bpe, near_copies, packing, pii, quality_rules, simhash, substring_dedup

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = ["doc_id", "a.b", "TEXT", "text", "spans", "text_hash", "c0", "mark", "_may", "n_chars", "N_CHARS", "kept", "_n_words"]
    rows = [(r["doc_id"], "x", "other", r["text"], 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in docs.where("doc_id < 12 or doc_id > 79").collect()]
    rows += rows[:4] + [(None, *r[1:]) for r in rows[:3]]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string' if n in ('a.b', 'TEXT', 'text') else 'int'}" for n in names)
    frame = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, `a.b` int, QUALITY int")
    n = len(rows)
    assert pii.detect(frame).count() == bpe.encode(frame, path, public_tokenizers.PATTERN).count() == quality_rules.judge(frame, labels).count() == simhash.near_duplicates(frame).count() == n
    assert sum(r["start"] == 0 for r in packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()) == n
    assert substring_dedup.counted(frame).count() == n
    import corpus_pipeline

    for f in (pii.redact(frame), quality_rules.keep(frame, labels), substring_dedup.clean(frame), near_copies.first_of_groups(frame), corpus_pipeline._sized(frame)):
        assert f.columns == names
        got = f.collect()
        assert got and all(tuple(r)[1:3] == ("x", "other") and tuple(r)[6] == 3 for r in got)
    want = removed([(r[0], r[3] or "") for r in rows if r[0] is not None])
    assert {r[0]: " ".join((r[3] or "").encode().decode().split(" ")) for r in substring_dedup.clean(frame).collect() if r[0] in (82, 84)} == {i: want[i][2] if want[i][1] else next(r[3] for r in rows if r[0] == i) for i in (82, 84)}


def test_empty_tables(spark):
    from facetflow.llm import bpe, embedding_dedup, near_copies, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup

    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for frame in (packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), bpe.encode(none, path, public_tokenizers.PATTERN), pii.detect(none), quality_rules.judge(none, labels), simhash.near_duplicates(none), near_copies.first_of_groups(none), substring_dedup.clean(none), substring_dedup.counted(none), quality_classifier.classify(none, quality_classifier.fit(none, labels)), embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert frame.collect() == []


def test_pipeline_stages_against_plain_python(spark):
    """Each stage on the output of the one before; the second one has a test of its own."""
    import corpus_pipeline
    from facetflow.llm import pii, quality_rules

    folder = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(None, "null id " * 30, "en", "s", 1), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], docs.schema))
    columns = docs.columns
    rows = lambda f: {r["doc_id"]: r["text"] for r in f.collect()}
    before = rows(docs)
    forest, use, threshold = quality_rules.fit(docs, labels)
    want = {}
    for i, t in before.items():
        counts, features = quality_rules.statistics(t or "")
        anomaly = forest.score(np.array([[features[k] for k in use]]))[0]
        if counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0] and anomaly < threshold:
            want[i] = t
    docs = stages["quality_rules"](spark, docs, folder)
    assert docs.columns == columns and rows(docs) == want
    docs = stages["simhash_near_dedup"](spark, docs, folder)
    before = rows(docs)
    assert docs.columns == columns and set(before) <= set(want) and len(before) < len(want)
    docs = stages["substring_dedup"](spark, docs, folder)
    known = removed([(i, t) for i, t in before.items() if i is not None])
    want = {i: known[i][2] if i in known and known[i][1] else t for i, t in before.items()}
    assert docs.columns == columns and rows(docs) == want and sum(n for _, n, _ in known.values()) > 0
    docs = stages["pii"](spark, docs, folder)
    got = rows(docs)
    for i, t in want.items():
        out, end = "", 0
        for kind, start, stop, _ in pii.find(t):
            if start >= end:
                out += t[end:start] + f"[{kind.upper()}]"
            end = max(end, stop)
        assert got[i] == out + t[end:]
    assert docs.columns == columns and any("[EMAIL]" in t for t in got.values()) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of: dict = {}
    for r in sorted(stages["packing"](spark, docs, folder).collect(), key=lambda r: r["start"]):
        of.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert of == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in got.items()}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
    key = lambda r: (r["doc_id"], r["start"])
    joined = lambda f: hashlib.sha256(b"".join(bytes(r["ids"]) for r in sorted(f.collect(), key=key))).hexdigest()
    assert joined(corpus_pipeline.run(spark, folder)) == joined(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
