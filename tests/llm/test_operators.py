"""The ten operators against brute-force versions, contracts' SQL, and awkward tables."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from oracle import assert_same

import public_tokenizers
from diffsignal.llm import html_extraction, licenses, passages, queries, store, tokens
from diffsignal.llm.components import components
from diffsignal.llm.decontamination import EQUAL, MASKS, WINDOW, leaks
from diffsignal.llm.html_extraction import content_side, extract, main_text
from diffsignal.llm.licenses import license_digest
from diffsignal.llm.line_dedup import drop_recurring_lines
from diffsignal.llm.near_duplicates import near_duplicates
from diffsignal.llm.packing import pack
from diffsignal.llm.passages import near_passages, repeated_stretches
from diffsignal.llm.quality import keep_good, quality
from diffsignal.llm.sharding import hilbert_index, hilbert_shards, write_shards
from diffsignal.llm.token_counts import count_tokens, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = f"e{rng.random()}"
    return " ".join(w)


LONG = " ".join(f"long{i % 7919}" for i in range(120_000))
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t\n", None), (4, "one", "a"), (4, "one", "a"), (None, "null id text with a few words in it to read", "b"), (None, None, None),
    (5, LONG, "b"), (6, "Ünïcode ＡＢＣ 数字 one two 😀 <|endoftext|> x", "c"), (7, "MIT License. Apache License, Version 2.0; licensed under the GNU General Public License v3", "c"), (8, "\x00 nul \x1f bytes", "c"),
]
CLASHING = "key long, cls long, n long, at int, host string, words int, lines int, leaf int, template int, shard int, slot int, __key int, salt int, part int, ids int, n_lines int, text_hash int, windows int, first int"


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")]) if extra else df


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


BY_ROW = {"quality": quality, "near": near_duplicates, "tokens": lambda d: token_counts(d, WORD), "shards": hilbert_shards, "licenses": license_digest, "lines": drop_recurring_lines}


@pytest.mark.parametrize("name", BY_ROW)
def test_awkward_rows_each_give_a_row(awkward, name):
    got = BY_ROW[name](awkward).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in AWKWARD)
    assert BY_ROW[name](awkward.limit(0)).count() == 0


def test_awkward_rows_of_the_others(awkward):
    assert {r["doc_id"] for r in pack(awkward, BYTE).collect()} == {r[0] for r in AWKWARD}
    assert near_passages(awkward).count() == 0 and near_passages(awkward.limit(0)).count() == 0
    bench = awkward.selectExpr("doc_id AS item_id", "text", "n")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(awkward, bench).collect()} >= {(5, 5), (7, 7)}
    assert leaks(awkward, bench.limit(0)).count() == 0 and leaks(awkward.limit(0), bench).count() == 0
    assert keep_good(awkward).columns == awkward.columns
    pages = awkward.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "n AS text")
    assert extract(pages).count() == len(AWKWARD) and pack(awkward.limit(0), BYTE).count() == 0


# ---- 1 lines ----


def test_recurring_lines_go_and_copies_stay(spark):
    texts = []
    for i in range(30):
        own = [sentence(12), sentence(9)]
        texts.append("\n".join([own[0], "all rights belong to the site owners", own[1], f"posted by user {i} on day {i * 7}", "ok"]))
    copy = "\n".join(sentence(11) for _ in range(4))
    texts += [copy] * 25
    texts += ["the same\nlonely text\nstays as it is here", "", None]
    got = {r["doc_id"]: r for r in drop_recurring_lines(table(spark, texts), min_docs=10).collect()}
    for i in range(30):
        own = texts[i].split("\n")
        assert got[i]["text"] == "\n".join([own[0], own[2], own[4]]) and (got[i]["n_lines"], got[i]["n_dropped"]) == (5, 2)
    assert all(got[i]["text"] == texts[i] and got[i]["n_dropped"] == 0 for i in range(30, len(texts)))
    assert got[len(texts) - 1]["n_lines"] == 0


def test_templates_do_not_depend_on_order(spark):
    names = [f"name{chr(97 + i)}" for i in range(20)]
    lines = [f"visit the page of {n} to read more" for n in names]
    texts = [f"{sentence(15)}\n{x}" for x in lines]
    kept = lambda t: sorted(r["text"] for r in drop_recurring_lines(table(spark, t), min_docs=10).collect())
    assert kept(texts) == kept(texts[::-1]) == sorted(t.split("\n")[0] for t in texts)


def test_the_query_and_the_pipeline_drop_short_lines(spark, tmp_path):
    import corpus_pipeline

    own = random.Random(7)
    bodies = [" ".join(own.choice(VOCABULARY) for _ in range(15)) for _ in range(12)]
    docs = table(spark, [f"{b}\nRead more\n\nShare" for b in bodies])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (queries.op1_line_dedup(spark, str(tmp_path)), corpus_pipeline.line_dedup(spark, docs, str(tmp_path))):
        assert sorted(r["text"] for r in got.collect()) == sorted(f"{b}\n" for b in bodies)


def test_numbers_are_fields_beside_a_word(spark):
    own = random.Random(8)
    bodies = [" ".join(own.choice(VOCABULARY) for _ in range(25)) + f"\n{i} | {i + 5} | {i * 3}" for i in range(20)]
    lines = lambda i: f"Page {i} of {i + 7}\n{i} comments posted\nPosted on {i + 1} March {2000 + i}\n2021-03-{i + 10} 12:{i + 10} INFO started"
    got = drop_recurring_lines(table(spark, [f"{b}\n{lines(i)}" for i, b in enumerate(bodies)]), min_docs=10, copied=0.9).collect()
    assert sorted(r["text"] for r in got) == sorted(bodies)


# ---- 2 quality ----


def test_host_rates_are_shrunk(spark):
    rows = [(i, sentence(40), "good") for i in range(60)] + [(100 + i, "# " * 30 + sentence(5), "bad") for i in range(60)] + [(200, "# " * 30 + sentence(5), "tiny")]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_rate=0.8).collect()}
    assert got[0]["kept"] and not got[100]["kept"] and got[100]["host_rejected"]
    kept = keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_rate=0.8)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


# ---- 3 near duplicates ----


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_near_duplicates_against_brute_force(spark):
    texts = [None, "", " ", "one two", "One Two", "one two three four five"]
    line = "the very same nine words stand in many documents"
    for size in (12, 30, 60, 90, 130, 200, 300, 600):
        base = sentence(size)
        texts += [base, base.upper(), *(edited(base, k) for k in range(1, max(2, size // 20)) for _ in range(2)), f"{base} {sentence(size // 6)}"]
    hub = sentence(80)  # a crowd of variants around a text that is not there, most of them no links
    texts += [edited(hub, k) for k in (1, 2, 3, 4, 5) for _ in range(14)]
    texts += [f"{line} {sentence(4)}" for _ in range(40)] + [f"{line} {sentence(6)}" for _ in range(20)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(5, 5), (None, 3), (30, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(7, 31), 7)}


# ---- 4 and 9 tokens ----

HARD = ["", "a", "it's I'M we'll" * 50, "x" * 3000, "  \n\n  tabs\t\tand   spaces  " * 40, "数字 and <|endoftext|> <|startoftext|> x 12345 ２３ " * 30, "naïve café é İstanbul ǅ ß " * 60, sentence(2000), "no_space_here" * 500, "1 2 3 " * 800, "a b c " * 90]


def test_token_counts_against_the_library(spark):
    enc = tokens.Encoder(WORD)
    for t in HARD:
        n = len(enc.library.encode(t, add_special_tokens=False).ids)
        assert [count_tokens(enc, t, c, o) for c, o in ((64, 8), (200, 40), (1 << 15, 1 << 9))] == [n] * 3
    got = {r["doc_id"]: r for r in token_counts(table(spark, [*HARD, None]), WORD, limit=100, chunk=256, overlap=32).collect()}
    for i, t in enumerate([*HARD, None]):
        n = len(enc.library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)


def test_splice_widens_overlaps_until_they_agree():
    enc = tokens.Encoder(WORD)
    text = "z" * 700 + " " + sentence(60) + "q" * 900
    assert count_tokens(enc, text, 100, 4) == len(enc.library.encode(text, add_special_tokens=False).ids)


def test_packing_loses_no_token(spark):
    texts = [*HARD, None, sentence(5000)]
    library = tokens.Encoder(BYTE).library
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = pack(table(spark, texts), BYTE, length=1024).collect()
    held = {}
    for r in rows:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    assert sorted(held) == list(range(len(held)))
    for k, pieces in held.items():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends == 1024 or k == max(held) and ends <= 1024


# ---- 5 shards ----


def test_shards_are_even_and_gapless(spark, tmp_path):
    docs = spark.createDataFrame([(i, sentence(rng.randint(1, 60)) if i % 3 else "same", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(501)], "doc_id long, text string, source string")
    rows = hilbert_shards(docs, 16).collect()
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r)
    assert sorted(per) == list(range(16)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    order = []
    for k in sorted(per):
        assert sorted(r["slot"] for r in per[k]) == list(range(len(per[k])))
        order += [r["curve"] for r in sorted(per[k], key=lambda r: r["slot"])]
    assert order == sorted(order)
    assert all(r["law"] == "rows" and r["grown_shard"] is None and r["size"] == len((t := texts[r["doc_id"]]).encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) for texts in [{d["doc_id"]: d["text"] for d in docs.collect()}] for r in rows)
    write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 501


def test_the_curve_moves_one_step_at_a_time():
    places = {hilbert_index(p, 3): p for p in itertools.product(range(8), repeat=3)}
    assert sorted(places) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(places[i], places[i + 1])) == 1 for i in range(511))


def test_files_prune_by_source_language_and_size(spark, tmp_path):
    from pyspark.sql import functions as F

    own = random.Random(31)
    docs = spark.createDataFrame([(i, "x" * int(2 ** own.uniform(3, 14)), f"s{own.randrange(40):02d}", own.choice(["de", "en", "fr", "it"])) for i in range(4000)], "doc_id long, text string, source string, lang string").withColumn("size", F.length("text"))
    write_shards(docs, str(tmp_path / "curve"))
    docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).repartition("shard").write.partitionBy("shard").parquet(str(tmp_path / "random"))
    read = {}
    for order in ("curve", "random"):
        files = spark.read.parquet(str(tmp_path / order)).groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        hit = lambda c, v: sum(r[f"lo_{c}"] <= v <= r[f"hi_{c}"] for r in files)
        read[order] = [sum(hit("source", f"s{k:02d}") for k in range(40)) / 40, sum(hit("lang", v) for v in ("de", "en", "fr", "it")) / 4, sum(hit("size", 1 << k) for k in range(4, 14)) / 10]
    print("shards of 16 read by source, lang, size:", read)
    assert all(a <= 0.7 * b for a, b in zip(read["curve"], read["random"]))
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "curve")).select("doc_id").collect()) == list(range(4000))


# ---- 6 licenses ----

BASES = {"gpl": ["gnu", "general", "public", "license"], "apache": ["apache", "license"], "cc-by": ["cc", "by"], "mit": ["mit", "license"]}


def test_license_digest_against_plain_search(spark):
    parts = [" ".join(v) for v in BASES.values()] + ["CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0", "cc", "by", "license", "mit mit", "gnu", "ÄMIT License", "SPDX-License-Identifier: MIT", "GPLv3", "x", "the"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "", "---"]
    got = {r["doc_id"]: r for r in license_digest(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(k, label) for label, phrase in BASES.items() for k in range(len(w)) if w[k : k + len(phrase)] == phrase]
        r, starts = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert licenses.scan_text(t) == licenses.scan_text(t, gated=False)
    assert len(licenses.RULES) > 200


def test_suppression_against_all_pairs():
    for _ in range(200):
        found = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 20)
            found.append((rng.randrange(len(licenses.RULES)), a, a + rng.randint(1, 8), "x"))
        tier = lambda f: licenses.RULES[f[0]].tier
        kept = []
        for i in sorted(range(len(found)), key=lambda i: (tier(found[i]), found[i][1], -found[i][2], found[i][0])):
            if not any(found[j][1] <= found[i][1] and found[i][2] <= found[j][2] for j in kept):
                kept.append(i)
        assert [i not in kept for i in range(len(found))] == licenses.suppressed(found)


def test_specific_rules_win():
    _, found = licenses.scan_text("This is licensed under the GNU General Public License, version 3.")
    assert [(d["label"], d["first"], d["last"]) for d in found if d["kept"]] == [("gpl-3", 2, 10)]


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("GPLv3", "gpl-3"), ("GNU GPL v3", "gpl-3"),
    ("Licensed under Apache-2.0", "apache-2.0"), ("MIT License 2019 John", "mit"), ("MIT license, 2 files", "mit"), ("BSD-3-Clause", "bsd-3-clause"), ("CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("the isc conference in ruby and vim", ""),
    ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc-4.0"), ("LGPLv2.1", "lgpl-2.1"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("GPL 2019 and gnu tools", ""), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("gnu general public license version 2 or later", "gpl,gpl-2"),
])
def test_labels_of_written_signatures(spark, text, labels):
    found = [d for d in licenses.scan_text(text)[1] if d["kept"] or d["base"]]
    assert ",".join(sorted({d["label"] for d in found})) == labels
    assert licenses.scan_text(text) == licenses.scan_text(text, gated=False)


# ---- 7 decontamination ----


def test_masks_hit_every_window():
    for changed in itertools.combinations(range(WINDOW), WINDOW - EQUAL):
        assert any(not any(s + o in changed for o in m) for m in MASKS for s in range(WINDOW - m[-1])), changed


def test_leaks_tolerate_substitutions(spark):
    items = [sentence(20), sentence(9), sentence(5)]
    docs = [f"{sentence(30)} {items[0]} {sentence(10)}", "x " + " ".join("zz" if i in (3, 14) else w for i, w in enumerate(items[0].split(" "))) + " y", sentence(60), f"{sentence(4)} {items[1].upper()}.", f"a {edited(items[1], 1)} b", f"p {items[2]} q", items[0][: len(items[0]) // 3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(table(spark, docs), bench).collect()}
    assert got == {(0, 0), (1, 0), (3, 1), (5, 2)}


def test_a_leak_of_one_text_is_told_whatever_else_its_id_holds(spark):
    item = sentence(20)
    docs = spark.createDataFrame([(1, f"a {item} b"), (1, "zzz " + sentence(40)), (2, "zzz " + sentence(40))], "doc_id long, text string")
    got = leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal"], r["item_words"], r["first_word"]) for r in got] == [(1, 7, 20, 20, 1)]


# ---- 8 passages ----


def test_compact_windows_against_their_definition():
    gen = np.random.default_rng(1)
    for _ in range(40):
        t, lens = int(gen.integers(2, 9)), gen.integers(0, 40, 5)
        n, first = int(lens.sum()), np.cumsum(lens) - lens
        end, sizes = first + lens, np.maximum(lens - t + 1, 0)
        if n < t or not sizes.sum():
            continue
        h = gen.permutation(n).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        m = passages.sliding_minima(h, t)
        assert all(m[s] == h[s : s + t].min() for s in range(n - t + 1))
        text = np.repeat(np.arange(5), sizes)
        starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[text]
        want = []
        for d in range(5):
            for i in range(first[d], end[d]):
                a = b = i
                while a > first[d] and h[a - 1] > h[i]:
                    a -= 1
                while b < end[d] - 1 and h[b + 1] > h[i]:
                    b += 1
                if b - a + 1 >= t:
                    want.append((i, a, b))
        assert want == list(zip(*(x.tolist() for x in passages.compact_windows(m[starts], starts, first[text], end[text], t))))


def test_passages_against_brute_force(spark):
    shared = [sentence(n) for n in (51, 60, 90, 200)]
    short = sentence(30)
    texts = [f"{sentence(rng.randint(0, 80))} {p} {sentence(rng.randint(0, 80))}" for p in shared for _ in range(4)]
    texts += [f"{sentence(40)} {edited(shared[3], 3)} {sentence(40)}", f"{sentence(60)} {short} {sentence(60)}", f"{sentence(60)} {short} {sentence(60)}", sentence(120), sentence(300)]
    copies = sentence(70)
    texts += [copies, copies, copies, f"{sentence(20)} {copies}"]
    rows = near_passages(table(spark, texts)).collect()
    split = [words(t) for t in texts]
    for r in rows:
        a, b = (" ".join(split[d][s : s + n]) for d, s, n in ((r["doc_id"], r["first_word"], r["n_words"]), (r["partner_id"], r["partner_word"], r["partner_words"])))
        x, y = shingles(a), shingles(b)
        assert r["doc_id"] != r["partner_id"] and r["n_words"] >= 50 and len(x & y) / len(x | y) == pytest.approx(r["jaccard"]) and r["jaccard"] >= 0.75
    runs = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 50):
            runs.setdefault(tuple(w[i : i + 51]), set()).add(d)
    assert {r["doc_id"] for r in rows} == set().union(*(s for s in runs.values() if len(s) > 1)) | {16}
    assert not {17, 18, 19, 20} & {r["doc_id"] for r in rows}


def test_variants_meet_an_original_that_comes_last(spark):
    """Each variant links with the original only, which has the highest id and other links of its own."""
    own = random.Random(5)
    bases = [[own.choice(VOCABULARY) for _ in range(56)] for _ in range(6)]
    texts = [" ".join([*b[:k], f"e{own.random()}", *b[k + 1 :]]) for b in bases for k in range(8, 48, 4)] + [" ".join(b) for b in bases]
    line = [f"l{i}" for i in range(25)]  # strangers that share a short line make every key around it crowded
    texts += [" ".join([own.choice(VOCABULARY) for _ in range(20)] + line + [own.choice(VOCABULARY) for _ in range(20)]) for _ in range(25)]
    texts += [" ".join([*texts[-1].split(" ")[:k], "changed", *texts[-1].split(" ")[k + 1 :]]) for k in (10,)]
    rows = near_passages(table(spark, texts)).collect()
    sets, found = [shingles(t) for t in texts], {r["doc_id"] for r in rows}
    linked = lambda i, j: len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])
    want = {i for i in range(len(texts)) if any(i != j and linked(i, j) for j in range(len(texts)))}
    assert want == found and len(want) == 68


def test_rare_places_meet_wherever_passages_link():
    gen = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        t, base = 12, gen.integers(0, 60, 40)
        pair = []
        for _ in range(2):
            v = base[int(gen.integers(0, 8)) :][: int(gen.integers(12, 33))].copy()
            v[gen.random(len(v)) < 0.08] = gen.integers(100, 10**6)
            pair.append(np.concatenate([gen.integers(10**6, 10**9, 5), v, gen.integers(10**6, 10**9, 5)]))
        often = {int(c): int(gen.integers(1, 9)) for c in set(pair[0].tolist()) & set(pair[1].tolist())}
        found = []
        for v in pair:
            n = np.array([often.get(int(c), 0) for c in v])
            kinds = passages.rare_places(v, n, np.ones(len(v), bool), np.array([len(v)]), t, 75)
            assert ((kinds & 15) == kinds >> passages.ASKED).all() and not kinds[n == 0].any()
            found.append({k: set(v[(kinds & k) > 0].tolist()) for k in (passages.ANY, passages.STRONG, passages.ODD, passages.BOTH_ODD)})
        sets = [[set(v[i : i + t].tolist()) for i in range(len(v) - t + 1)] for v in pair]
        if any(len(a & b) >= 0.75 * len(a | b) for a in sets[0] for b in sets[1]):
            met += 1
            a, b = found
            assert a[passages.STRONG] & b[passages.STRONG] or a[passages.ODD] & b[passages.ANY] or a[passages.ANY] & b[passages.ODD] or a[passages.BOTH_ODD] & b[passages.BOTH_ODD]
    assert met > 50


def test_alignment_goes_over_gaps():
    gen = np.random.default_rng(4)
    own = gen.integers(0, 1 << 31, 86)
    other = own.copy()
    other[40:51] = gen.integers(1 << 31, 1 << 32, 11)  # seven words in a row replaced: Jaccard 75 / 97
    [(a, b, q, s, j)] = passages.aligned(own, other, 46, 75)
    assert (a, b, q, s) == (0, 86, 0, 86) and j == 75 / 97
    both = np.concatenate([own, gen.integers(1 << 32, 1 << 33, 60), other])
    assert sorted(x[:2] for x in passages.aligned(both, own, 46, 75)) == [(0, 86), (146, 232)]


def test_recall_of_passages_just_above_the_threshold(spark):
    own = random.Random(21)
    word = lambda: f"r{own.randrange(10**6)}"
    texts, pairs = [], []
    while len(pairs) < 300:
        base = [word() for _ in range(own.choice((50, 60, 75, 90, 120)))]
        other = list(base)
        for _ in range(own.randint(1, 4)):
            k = own.randrange(len(other))
            other[k : k + own.randint(1, 4)] = [word() for _ in range(own.randint(0, 3))]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if len(other) >= 50 and 0.75 <= len(a & b) / len(a | b) <= 0.8:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join([word() for _ in range(own.randint(0, 40))] + v + [word() for _ in range(own.randint(0, 40))]) for v in (base, other)]
    got = {(r["doc_id"], r["partner_id"]) for r in near_passages(table(spark, texts)).collect()}
    found = sum(p in got for p in pairs)
    print("recall of passages between 0.75 and 0.8:", found / len(pairs))
    assert found >= 0.9 * len(pairs) and got <= {(a, b) for p in pairs for a, b in (p, p[::-1])}


def test_ids_with_several_texts_keep_their_links(spark):
    base, more = sentence(70), sentence(90)
    rows = [(1, base), (2, edited(base, 1)), (2, more), (3, f"{more} {sentence(30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["partner_id"]) for r in near_passages(docs).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect())[:3] == [(1, 1), (2, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_words_alone_in_a_partition(spark, n):
    from pyspark.sql import functions as F

    text = " ".join("x" * 60 for _ in range(n))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
    assert [(r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()] == [(1, 0)]
    assert near_passages(docs).count() == 0


# ---- 10 pages ----


def test_minimum_cut_against_enumeration():
    for _ in range(150):
        n = rng.randint(1, 8)
        caps = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        cost = lambda side: sum(t if s else c for s, (c, t) in zip(side, caps)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost(content_side(caps, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


@pytest.mark.parametrize("page, text", [
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two.<p>Three<br>four.</article><footer>&copy; us</footer>", "T & U One two. Three four."),
    ('<body class="has-sidebar"><header><h1>Site</h1></header><div class="main-content"><p>Some long sentence of the article goes here, yes.</p><div class="comments"><p>A reader says something long enough to matter.</p></div></div><aside>Related stuff</aside>', "Some long sentence of the article goes here, yes."),
    ("<article><p>a<b>b</b>c &lt;p&gt; d</p><script>var x = '</p>';</script><!-- no --><form><label>Name</label><input></form></article>", "abc <p> d"),
    ('<article><p>kept</p><div class="ad">buy now, a long advert text with many words.</div><p>also kept</p></article>', "kept also kept"),
    ("<article><p>cut off &am", "cut off &am"), ("<p unclosed", ""), ("<<<<", ""), ("", ""), (None, ""),
    ("<article><p>one <svg class=icon/> two</p><p>three <svg><title>t</title><path d=x /></svg>four</p></article>", "one two three four"),
    ("<article><p>one <select><option>a<option>b</select> two <svg><style/></svg>three</p><p>x<object><p>fallback</object>y</p></article>", "one two three x y"),
    ("<article><div><select><option>a<option>b</div><p>after</p><div><object data=x>fallback</div><p>end</p></article>", "after end"),
    ('<article><p hidden>secret text that nobody sees at all.</p><p>seen</p></article>', "seen"),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_every_article_of_the_test_pages(spark):
    import html as entities

    bad = 0
    for r in extract(spark.read.parquet(f"{SMALL}/pages.parquet")).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"</?b>", "", s)).split()) for s in re.split(r"</?(?:p|h1|br)>", re.sub(r"<[^>]*\Z", "", inner))]
        bad += r["text"] != " ".join(p for p in parts if p) or r["n_chars"] != len(r["text"])
    assert bad == 0
    assert html_extraction.CONTEXT[1] > 0 > html_extraction.CONTEXT[-2]


def test_the_cut_beats_the_sign_of_the_score_on_plain_pages():
    """Pages without article elements or telling names: short paragraphs of the text lie among long ones, lists of links outside."""
    from diffsignal.llm.html_blocks import blocks

    own = random.Random(5)
    text = lambda n: " ".join(own.choice(VOCABULARY) for _ in range(n)) + "."
    hits = {"cut": [0, 0, 0], "sign": [0, 0, 0]}
    for _ in range(150):
        links = "".join(f"<li><a href=x>{text(own.randint(1, 3))}</a></li>" for _ in range(own.randint(4, 10)))
        body = [("h2", text(own.randint(2, 5))) if (r := own.random()) < 0.2 else ("p", text(own.randint(3, 7))) if r < 0.45 else ("p", text(own.randint(15, 60))) for _ in range(own.randint(4, 10))]
        page = f"<html><body><div><ul>{links}</ul></div><div>{''.join(f'<{t}>{x}</{t}>' for t, x in body)}</div><div><ul>{links}</ul><div>{text(4)}</div></div></body></html>"
        good, found = {x for _, x in body}, blocks(page)
        sides = {"cut": content_side(*html_extraction.network(found)), "sign": [html_extraction.score(b) > 0 for b in found]}
        for name, side in sides.items():
            for b, kept in zip(found, side):
                at = 0 if kept and b.text in good else 1 if kept else 2 if b.text in good else None
                if at is not None:
                    hits[name][at] += 1
    f1 = {k: 2 * a / (2 * a + b + c) for k, (a, b, c) in hits.items()}
    assert f1["cut"] > 0.99 and f1["sign"] < 0.95, f1


def test_deep_nesting_is_linear():
    import time

    from diffsignal.llm.html_blocks import blocks

    began = time.perf_counter()
    assert len(blocks("<div>x" * 40_000)) == 40_000 and time.perf_counter() - began < 10


def test_groups_are_told_by_membership(spark):
    """Pairs of exact repeats, near each other and around a hub, are one component; a long crowd has a row a member."""
    own = random.Random(8)
    word = lambda: f"g{own.randrange(10**6)}"
    pad = lambda: [word() for _ in range(own.randint(0, 30))]
    texts, exact = [], []
    for _ in range(12):
        base = [word() for _ in range(own.randint(70, 120))]
        other = [*base[:20], "changed", *base[21:45], "again", *base[46:]]
        for v in (base, other):
            exact.append((len(texts), len(texts) + 1))
            texts += [" ".join(pad() + v + pad()) for _ in range(2)]
        texts.append(" ".join(pad() + base[10:48] + pad()))
    crowd = len(texts)
    base = [word() for _ in range(90)]
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in own.choices(range(90), k=60)]
    rows = repeated_stretches(table(spark, texts)).collect()
    named = {(r["doc_id"]): (r["component_id"], r["component_word"]) for r in rows}
    assert len({(r["doc_id"], r["first_word"]) for r in rows}) == len(rows)
    assert all(a in named and named[a] == named.get(b) for a, b in exact)
    assert len({named[a] for a, _ in exact}) == 12 and not {d for d in range(4, crowd, 5)} & set(named)
    assert {named.get(d) for d in range(crowd, len(texts))} == {(crowd, 0)} and sum(r["doc_id"] >= crowd for r in rows) == 60
    assert all(r["jaccard"] >= 0.75 and r["n_words"] >= 50 and r["n_links"] >= 1 for r in rows)
    found = {r["doc_id"] for r in near_passages(table(spark, texts)).collect()}
    assert found == set(named)
    assert repeated_stretches(table(spark, texts).limit(0)).count() == 0 and repeated_stretches(table(spark, texts[:1])).count() == 0


def test_covered_places_of_two_components_still_meet(spark):
    """Places that verified passages cover meet all the same, unless their whole key is within one component."""
    shared = spark.createDataFrame([(1, 3, 10, 100), (1, 3, 20, 100), (1, 3, 30, 100), (2, 2, 10, 120), (2, 2, 20, 120), (3, 2, 20, 61), (3, 2, 10, 100)], "key long, n long, cls long, at int")
    told = spark.createDataFrame([(10, [(60, 200, 7)]), (20, [(60, 200, 7)]), (30, [(60, 200, 8)])], "cls long, told array<struct<begin:int,end:int,component:long>>")
    left = {tuple(r) for r in passages._unsettled(shared, told, 46).select("key", "cls", "c").collect()}
    assert left == {(1, 10, 7), (1, 20, 7), (1, 30, 8), (3, 20, None), (3, 10, 7)}
    met = {(r["x"], r["p"]) for r in passages._few(passages._unsettled(shared, told, 46), 46).collect()}
    assert met == {(10, 30), (20, 30)}


def test_passages_share_a_place():
    """Any two passages just above the threshold have a chosen place of one shingle, also where few words recur in another order."""
    own = random.Random(17)
    for size in (20, 10**6):
        for _ in range(60):
            base = [f"m{own.randrange(size)}" for _ in range(own.randint(60, 150))]
            other = list(base)
            while True:
                k = own.randrange(len(other))
                edit = other[:k] + [f"n{own.random()}" for _ in range(own.randint(0, 1))] + other[k + 1 :]
                a, b = shingles(" ".join(base)), shingles(" ".join(edit))
                if len(edit) < 50 or len(a & b) < 0.75 * len(a | b):
                    break
                other = edit
            keys = []
            for v in (base, other):
                data = np.frombuffer(" ".join(["before"] * 3 + v + ["behind"] * 3).encode(), np.uint8)
                code, at, _ = passages.chosen(tokens_of(data), 46)
                keys.append(set(code[at].tolist()))
            assert keys[0] & keys[1]


def tokens_of(data):
    return passages.Words(data, np.array([0, len(data)]))


def test_counts_taken_while_writing(spark):
    """A table is written and counted by one job: what it may be broadcast by needs none of its own, also where it is empty."""
    from pyspark.sql import functions as F

    sc = spark.sparkContext
    df = spark.range(1000, numPartitions=3).select("id", F.repeat(F.lit("x"), 10).alias("text"))

    def jobs(f):
        group = f"counted-{f.__name__}-{id(f)}"
        sc.setJobGroup(group, group)
        try:
            out = f()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return out, len(sc.statusTracker().getJobIdsForGroup(group))

    (out, few), n = jobs(lambda: store.kept(df, "t", F.octet_length("text")))
    assert few and n == 1 and out.count() == 1000
    (_, few), _ = jobs(lambda: store.kept(df, "t", F.octet_length("text") * 10_000))
    assert not few
    for empty in (df.limit(0), df.filter("id < 0"), df.filter("id < 0").groupBy("text").count()):
        out, few = store.kept(empty, "t")
        assert few and out.count() == 0 and store.measured(empty, "t", F.count(F.lit(1)).alias("n"), F.sum(F.lit(1)).alias("s"))[1] == {"n": 0, "s": None}


def test_candidates_that_cannot_hold_a_passage_end_before_they_are_aligned(monkeypatch):
    rng, t, percent = np.random.default_rng(5), 46, 75
    pairs, looked = [], []
    for n in range(200):
        x = rng.integers(0, 1 << 32, 120, dtype=np.uint32)
        p = rng.integers(0, 1 << 32, 120, dtype=np.uint32)
        shared = int(rng.integers(0, 70))
        p[20 : 20 + shared] = x[30 : 30 + shared]
        pairs.append((x, p))
    expected = [(i, *found[:4]) for i, (x, p) in enumerate(pairs) for found in passages.aligned(x, p, t, percent)]
    assert 20 < len({row[0] for row in expected}) < 100
    column = lambda k: [pair[k].astype("<u4").tobytes() for pair in pairs]
    zero, number = [0] * len(pairs), list(range(len(pairs)))
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in (number, zero, zero, zero, column(0), column(1))], names=["x", "p", "x_lo", "p_lo", "x_shingles", "p_shingles"])
    align = passages.aligned
    monkeypatch.setattr(passages, "aligned", lambda *args: looked.append(1) or align(*args))
    got = [(r["x"], r["x_from"], r["x_to"], r["p_from"], r["p_to"]) for b in passages._verified(t, percent)(iter([batch])) for r in b.to_pylist()]
    assert got == expected
    assert len(looked) < 120  # all 200 were aligned before


def test_places_are_sorted_once_for_all_components(monkeypatch):
    rng, t = np.random.default_rng(6), 46
    code = rng.integers(0, 400, 600)
    told = [{"begin": a, "end": a + 90, "component": a} for a in (0, 150, 300, 450)]
    often = np.unique(code, return_inverse=True)[1] % 3
    held = [{"i": int(i), "often": int(often[i])} for i in np.flatnonzero(often)]
    kinds = pa.list_(pa.struct([("i", pa.int32()), ("often", pa.int64())])), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("component", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([code.tolist()]), pa.array([held], kinds[0]), pa.array([told], kinds[1])], names=["cls", "begin", "shingles", "held", "told"])
    sorted_, order = [], passages._ordered
    monkeypatch.setattr(passages, "_ordered", lambda *args: sorted_.append(1) or order(*args))
    got = sorted((r["shingle"], r["at"], r["kinds"], r["c"] or 0) for b in passages._rare(t, 60)(iter([batch])) for r in b.to_pylist())
    assert len(sorted_) == 1 and len({r[3] for r in got}) > 2  # one sort a component before
