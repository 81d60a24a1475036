"""Language model, conversation repair, phrases and language threshold against brute-force versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotspark.llm import langid, lm, ngram_trie, phrases, queries, repair, secret_scan

from ..compare import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- language model -----------------------------------------------------------------------------
def test_rising_numbers():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (1000, 2000), (5000, 10**12), (1000, 1000)):
        own = np.sort(rng.choice(top, n, replace=False)) if top < 10**6 else np.unique(rng.integers(0, top, n))
        rising = ngram_trie.Rising.build(own)
        assert not n or (rising.access(np.arange(len(own))) == own).all()
        asked = np.concatenate([own, rng.integers(0, top + 10, 2000)])
        assert (rising.successor(asked) == np.searchsorted(own, asked)).all()
        assert (rising.find(asked) == np.where(np.isin(asked, own), np.searchsorted(own, asked), -1)).all()
        assert n < 1000 or 8 * sum(a.nbytes for a in rising.arrays()) < len(own) * (4 + math.log2(max(2, top / len(own))))
    key = np.unique(rng.integers(0, 50, 800) * 1000 + rng.integers(0, 300, 800))
    ranges = ngram_trie.Ranges.build(key // 1000, key % 1000, 60)
    parent, number = rng.integers(-1, 60, 4000), rng.integers(0, 310, 4000)
    place = {int(k): i for i, k in enumerate(key)}
    assert ranges.find(parent, number).tolist() == [place.get(int(p) * 1000 + int(m), -1) if p >= 0 else -1 for p, m in zip(parent, number, strict=True)]


def model_of(texts, a, b):
    """id -> (tokens, known, base, score) by plain counting; N."""
    start, end = ("start",), ("end",)
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), end] for i, (t, _) in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    for i, (_, learn) in texts.items():
        if learn:
            u = v = start
            two[u, v] += 1
            for w in toks[i]:
                one[w] += 1
                two[v, w] += 1
                three[u, v, w] += 1
                u, v = v, w
    total, size, docs = sum(one.values()), len(one), sum(bool(x) for _, x in texts.values())
    out = {}
    for i in texts:
        base = score = 0.0
        u = v = start
        for w in toks[i]:
            p = (one[w] + 1) / (total + size + 1)
            base += math.log10(p)
            p = (two[v, w] + a * p) / ((docs if v == start else one[v]) + a)
            score += math.log10((three[u, v, w] + b * p) / (two[u, v] + b))
            u, v = v, w
        out[i] = (len(toks[i]), sum(one[w] > 0 for w in toks[i]), base, score)
    return out, total


def test_language_model_equals_counting(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.expr("pmod(crc32(cast(doc_id as string)), 7) <> 2").alias("learn"))
    odd = spark.createDataFrame([(-1, None, True), (-2, "", False), (-3, " \n ", None), (-4, "b " * 30_000, True), (-5, "a" * 5000 + " b", True)], "doc_id long, text string, learn boolean")
    docs = docs.unionByName(odd)
    texts = {r.doc_id: (r.text, r.learn) for r in docs.collect()}
    want, total = model_of(texts, lm.PAIR_WEIGHT, lm.TRIPLE_WEIGHT)
    got = {r.doc_id: r for r in lm.score_texts(docs.withColumn("chunk", F.lit("x")), "learn").collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[i][:2], total)
        assert r.base_score == pytest.approx(want[i][2], rel=1e-9, abs=1e-9) and abs(r.score - want[i][3]) <= r.n_tokens / ngram_trie.STEPS
    held = [i for i in got if i >= 0 and not texts[i][1]]
    assert sum(got[i].score for i in held) > 0.95 * sum(got[i].base_score for i in held)
    # texts that are cut and words with several tries change nothing
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    again = {r.doc_id: r for r in lm.score_texts(docs, "learn", trie_tokens=3000, hot=300).collect()}
    assert {i: r.asDict() for i, r in again.items()} == {i: r.asDict() for i, r in got.items()}


def test_language_model_without_texts_and_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", False), (1, "a b", False), (None, "c", None)], "doc_id long, text string, learn boolean")
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_texts(df, "learn").collect()))
    assert got == [(2, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm.score_texts(df.limit(0), "learn").count() == 0


# --- conversations ------------------------------------------------------------------------------
def cheapest(initials, faults):
    """Least (cost, audit) by carrying all audits of four states."""
    best = {0: (0, "")}
    for c, f in zip(initials, faults, strict=True):
        ways = {}
        for p, (cost, audit) in best.items():
            for before, after, price, own in repair.edits(c, f):
                if before == p:
                    ways[after] = min(ways.get(after, (1 << 40, "")), (cost + price, audit + own))
        best = ways
    return min((cost + 3 * repair.CLOSING[q], audit + "I" * repair.CLOSING[q]) for q, (cost, audit) in best.items())


def test_rebuilt_edits_are_the_cheapest(spark):
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 14)
        initials, faults = ("".join(rng.choice(x) for _ in range(n)) for x in ("suaaux", "....tbd"))
        size = rng.randint(1, 6)
        blocks = []
        for i in range(0, n, size):
            vectors = [repair.forward(initials[i : i + size], faults[i : i + size], 0, len(initials[i : i + size]), p) for p in range(4 if i else 1)]
            blocks.append({"part": 0, "seq": i, "costs": [c for v in vectors for c in v[0]], "ranks": [r for v in vectors for r in v[1]]})
        cost, path, closing = repair.joined(blocks)
        audit = "".join(repair.rebuild(initials[i : i + size], faults[i : i + size], p, q) for (_, i, p, q) in path) + "I" * closing
        assert (cost, audit) == cheapest(initials, faults)
        roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        lines = repair.repaired(audit, 0, [roles[c] for c in initials], ["t"] * n)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_repair_does_not_depend_on_blocks(spark):
    turns = queries.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    odd = spark.createDataFrame(
        [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (-1, None, None, None), (-2, 1, "user", "a."), (-2, 1, "user", "a."), (-2, 5, "user", "b"), (-2, 9, "assistant", "a.")] + [(-3, i, "user", "Same.") for i in range(60)],
        "conv_id long, turn long, role string, text string",
    )
    both = turns.unionByName(odd).withColumn("part", F.lit("x"))
    ids = spark.createDataFrame([(-9,), (None,)], "conv_id long")
    whole = {r.conv_id: r.asDict() for r in repair.repair_conversations(both, conversations=ids).collect()}
    cut = {r.conv_id: r.asDict() for r in repair.repair_conversations(both, conversations=ids, block_rows=2).collect()}
    assert whole == cut
    assert whole[-9]["audit"] == "" and whole[-9]["cost"] == 0 and whole[-1]["blank"] == 1 and whole[-1]["gaps"] == 0 and whole[-1]["audit"] == "D"
    assert (whole[-2]["gaps"], whole[-2]["duplicate"], whole[-2]["truncated"], whole[-2]["illegal"]) == (6, 1, 1, 2)
    assert whole[-3]["duplicate"] == 59 and whole[None]["audit"] == "IKKI"
    assert repair.repair_conversations(both.limit(0)).count() == 0


# --- phrases ------------------------------------------------------------------------------------
def test_phrases_are_whole_whatever_the_sample(spark):
    rng = random.Random(6)
    words = ["of", "the", "a", "state", "new", "york", "city", "x"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(60))
        rows.append((i, text.replace("new york", "NEW YORK") + " new york city hall" * rng.randint(0, 2), rng.choice(["en", "de", None])))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "x y z " * 500, "long")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("key", F.lit(0))
    want, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    want = {k: n for k, n in want.items() if n >= 20}
    for share in (1e-9, 0.3):  # without a sample every level is found by a failing border
        got = phrases.frequent_phrases(df, least=20, share=share).collect()
        assert {(r.lang, r.phrase): r.f for r in got} == want and all(r.n == totals[r.lang] and r.k == len(r.phrase.split(" ")) for r in got)
    assert phrases.collocations(df.limit(0)).count() == 0
    top = phrases.collocations(df, least=20, top=3).collect()
    assert max(r.rank for r in top) == 3 and len(top) <= 12


@pytest.mark.parametrize("moved", [False, True])
def test_phrases_are_spelled_in_one_chunk(spark, tmp_path, monkeypatch, moved):
    """Not in each of the chunks that hold them; all the same if the chunks aren't the counted ones any more."""
    from pyspark.sql.classic.dataframe import DataFrame

    size, made, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrame.mapInArrow
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(50)), rng.choice(["en", None])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(10).write.parquet(f"{tmp_path}/documents.parquet")

    def recorded(self, task, schema, *args):
        if "phrase" in schema:
            if moved:
                spark.conf.set(size, "7")
            made.append(plain(self, task, schema, *args))
            return made[-1]
        return plain(self, task, schema, *args)

    before = spark.conf.get(size)
    spark.conf.set(size, "20")
    monkeypatch.setattr(DataFrame, "mapInArrow", recorded)
    try:
        got = {(r.lang, r.phrase): r.f for r in phrases.frequent_phrases(spark.read.parquet(f"{tmp_path}/documents.parquet"), least=20).collect()}
        spelled = [x.count() for x in made]
    finally:
        spark.conf.set(size, before)
    want = Counter((lang or "und", text[2 * i : 2 * (i + k) - 1]) for _, text, lang in rows for k in range(1, 6) for i in range(51 - k))
    assert got == {k: n for k, n in want.items() if n >= 20}
    assert len(spelled) == 2 and spelled[1] > len(got) if moved else len(spelled) == 1 and len(got) <= spelled[0] <= 1.1 * len(got)


# --- languages ----------------------------------------------------------------------------------
def test_language_stage_drops_other_scripts_and_keeps_short_texts(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    rng = random.Random(8)
    made = lambda low, high, n: "".join(" " if rng.random() < 0.18 else chr(rng.randint(low, high)) for _ in range(n))
    scripts = {"hangul": (0xAC00, 0xD7A3), "cyrillic": (0x430, 0x44F), "greek": (0x3B1, 0x3C9), "han": (0x4E00, 0x9FA5)}
    strange, at = [], 1_000_000
    for low, high in scripts.values():
        for n in (80, 400):
            strange += [(at + i, made(low, high, n)) for i in range(50)]
            at += 100
    short = [(2_000_000 + i, t) for i, t in enumerate(["ok", "Guten Tag", "Yes.", "Buenos días", "merci", "a", "Über"])]
    gone = [(3_000_000, None), (3_000_001, ""), (3_000_002, "123 456"), (3_000_003, "да"), (None, "No id but words.")]
    extra = spark.createDataFrame([(i, t, None, "s", 1) for i, t in strange + short + gone], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.unionByName(extra).withColumns({c: F.lit("x") for c in ("lang_pred", "score", "_text")})
    rows = rows.unionByName(rows.where("doc_id = 5"))
    out = cp.language(spark, rows, SF)
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == cp.COLUMNS and kept[5] == 2
    assert sum(i in kept for i, _ in strange) <= 0.01 * len(strange)
    assert all(i in kept for i, _ in short) and not any(i in kept for i, _ in gone)
    clean = [r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert all(i in kept for i in clean)
    assert cp.language(spark, rows.limit(0), SF).count() == 0


def test_long_texts_are_bundled_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(chr(c) if c % 9 else " " for c in rng.integers(0x4E00, 0x9FA5, 20_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = langid._sums(data, offsets, 3, 128)
    monkeypatch.setattr(langid, "PIECE_BYTES", 1001)
    monkeypatch.setattr(langid, "GRAMS", 100)
    cut = langid._sums(data, offsets, 3, 128)
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist() == [True]


def test_language_of_ten_megabytes_keeps_to_its_memory():
    import resource

    rng = np.random.default_rng(4)
    data = np.frombuffer("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000_000))).encode() * 3, np.uint8)
    langid._sums(data[:3000], np.array([0, 3000]), 3, langid.DIMS)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    langid._sums(data, np.array([0, len(data)]), 3, langid.DIMS)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB


# --- secrets ------------------------------------------------------------------------------------
def test_common_credentials_are_found_whole_and_no_part_alone(spark):
    blocks = {
        "env": ("DB_USER=bob\nDB_PASSWORD=hunter22\nDB_HOST=db.local\n", {"bob", "hunter22", "db.local"}),
        "yaml": ("username:\tbob\npassword: p@ss!w0rd#12345\nhost: db.local\n", {"bob", "p@ss!w0rd#12345", "db.local"}),
        "json": ('{"client_id": "bob42", "client_secret": "s3cr3t", "endpoint": "db.local"}', {"bob42", "s3cr3t", "db.local"}),
        "ruby": (":login => 'bob', :token => 'abc12345', :server => 'db.local'", {"bob", "abc12345", "db.local"}),
        "url": ("postgres://bob:s3cr3t@db.local/x", {"bob", "s3cr3t"}),  # the address is no further part
    }
    rows = [(name, text) for name, (text, _) in blocks.items()]
    parts = [p for name, (text, _) in blocks.items() if name != "url" for p in re.split(r"[\n,]", text.strip("{}\n"))]
    df = spark.createDataFrame(rows + [(f"alone {i}", p) for i, p in enumerate(parts)], "doc_id string, text string")
    got = {r.doc_id: {r.text[s.start : s.end] for s in r.spans} for r in secret_scan.scan_secrets(df).join(df, "doc_id").collect()}
    assert {n: got[n] for n in blocks} == {n: want for n, (_, want) in blocks.items()}
    assert not any(v for n, v in got.items() if n.startswith("alone"))


def test_linking_over_documents_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ("user=bob " + "x " * 150 + "pwd=hunter22 ") * 20), (-2, "host: a.b " * 30 + "login: bobby key=abcdefgh")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in secret_scan.scan_secrets(docs).collect()}
    for r in docs.collect():
        parts = secret_scan.find_parts(r.text or "")
        near = lambda p, role, parts=parts: any(q[1] == role and q[3] <= p[4] + 400 and q[4] >= p[3] - 400 and (q[3] >= p[4] or q[4] <= p[3]) for q in parts)
        need = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
        assert got[r.doc_id] == {(p[0], p[3], p[4]) for p in parts if p[2] or all(near(p, role) for role in need[p[1]])}
