from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import components, decontaminate, entries, mixing, neardup, repetition, scratch, tokenfiles
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, f"Before, {PASSAGE.upper()}! after"),
    (6, f"{PASSAGE}\n{PASSAGE}\n{PASSAGE}\n"),
    (7, "short item"),
    (8, "x short-ITEM, y short item"),
    (9, "été çà été çà été çà  double  blank  nbsp  é"),
    (10, "a b c d e " * 5000),
    (11, "a b c d e " * 5000),
    (12, f"{PASSAGE} {PASSAGE} omicron"),
    (13, "y" * 70_000 + " z"),
    (14, "line\nline\nother\n\n\nline"),
    (15, "nul\0 byte <|endoftext|> and 1234's don't I'll \r\n x"),
]
ITEMS = [(1, PASSAGE), (2, "Short item"), (3, None), (4, ""), (None, "one"), (5, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def odd(spark):
    """The odd rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None if i % 3 else "s", 0, i, "x", "y") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, bucket long, key string, size string")


def test_decontaminate_odd(spark):
    got = decontaminate.report(decontaminate.scan(odd(spark), spark.createDataFrame(ITEMS, "item_id long, text string")))
    want = brute.decontaminate(ODD, ITEMS)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got, *cols) == sorted(want, key=str)
    blocks = decontaminate.report(decontaminate.scan(odd(spark), spark.createDataFrame(ITEMS, "item_id long, text string"), max_nodes=25))
    assert rows(blocks, *cols) == sorted(want, key=str)


def test_decontaminate_many_blocks(spark, docs, monkeypatch):
    """Blocks in turn, slices of items, repeated documents: as with one automaton; the memory of a block follows its nodes."""
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 30)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    twice = docs.unionByName(docs.limit(5))
    slices, n = decontaminate._blocks(bench, 10, 2000)
    assert n > 3 and slices.where("nodes > 300").isEmpty()
    want = brute.decontaminate([tuple(r) for r in twice.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = decontaminate.report(decontaminate.scan(twice, bench, max_nodes=2000))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    assert rows(decontaminate.clean(docs, bench, max_nodes=2000), "doc_id") == rows(decontaminate.clean(docs, bench), "doc_id")
    spans = lambda df: sorted((r["doc_id"], sorted(map(tuple, r["spans"])), sorted(r["items"])) for r in df.collect())
    assert spans(decontaminate.scan(docs, bench, max_nodes=2000)) == spans(decontaminate.scan(docs, bench))


def test_decontaminate_offsets(spark):
    found = decontaminate.scan(odd(spark).where("doc_id = 5"), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    span = found["spans"][0]
    assert ODD[4][1][span["start"] : span["end"]] == PASSAGE.upper()


def test_decontaminate_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.decontaminate([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows(entries.op1_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == sorted(((w[0],) for w in want if not w[5]), key=str)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(decontaminate.scan(odd(spark), none)).where("contaminated").count() == 0
    assert decontaminate.scan(odd(spark).limit(0), none).count() == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_repetition(spark, docs, which):
    df = odd(spark) if which == "odd" else docs
    want = brute.repetition([tuple(r) for r in df.select("doc_id", "text").collect()])
    got = rows(repetition.measure(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(want, key=str)
    kept = repetition.keep(df)
    assert kept.columns == df.columns and kept.count() == repetition.measure(df).where("kept").count()


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_repetition_verdict(spark, docs, which):
    df = odd(spark) if which == "odd" else docs
    names = ["dup_line_chars", *(f"dup_chars_{n}" for n in repetition.LENGTHS), "kept"]
    want = brute.repetition_rules([tuple(r) for r in df.select("doc_id", "text").collect()], repetition.LENGTHS, repetition.LINE_CHARS)
    assert rows(repetition.measure(df), "doc_id", *names) == sorted(want, key=str)


def test_repetition_coverage_counts_characters():
    raw, off = np.frombuffer(("abc de f g hi jk " * 2 + "tail").encode(), np.uint8), np.array([0, 38])
    m = repetition.measures(raw, off)
    assert m["dup_chars_5"][0] == m["dup_chars_6"][0] == 22 and m["dup_chars_7"][0] == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(spark, docs, which):
    df = odd(spark) if which == "odd" else docs
    want = brute.near([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert rows(neardup.link(df, size=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)


def test_near_duplicates_group_is_not_only_a_star(spark):
    """Chains, whose ends are not similar, and two groups in common buckets."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    made = []
    for i in range(40):
        made.append((i * 3 % 97, " ".join(base)))
        base = list(base)
        base[int(rng.integers(120))] = f"n{i}"
    made += [(200 + i, " ".join([*base[:60], *(f"q{i}_{k}" for k in range(60))])) for i in range(10)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(neardup.link(df, size=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(made), key=str)


def test_near_duplicates_of_a_repeated_id(spark):
    """Rows of one id many times, an id with two unlike texts, and a bucket whose members are not all of one component."""
    base = [f"w{k}" for k in range(60)]
    a, b = " ".join(base), " ".join([*base[:-1], "other"])
    made = [(3, a)] * 200 + [(5, b)] * 200 + [(5, "quite another text of five words more")] + [(9, "quite another text of five words more")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(made)], "doc_id long, text string, root long")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.link(df).distinct().collect()}
    assert got == {3: (3, True), 5: (3, False), 9: (3, False)}
    left = neardup.dedupe(df)
    assert left.columns == df.columns and rows(left, "doc_id", "text") == [(3, a)]
    pairs = spark.createDataFrame([(3, 5)], "u long, v long")
    known = df.select("doc_id").distinct()
    sets = neardup._once(df.select("doc_id", "text"), known)
    assert sets.count() == 4 and neardup._verified(pairs, sets, 5, 80).count() == 1


def test_blocks_meet_each_pair_of_roots_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    made = [("k", i, 0 if i < 17 else i) for i in range(30)] + [("one", i, 7) for i in range(9)]
    runs = neardup._in_blocks(spark.createDataFrame(made, "key string, id long, root long"), "key").collect()
    assert {r["key"] for r in runs} == {"k"}
    met = Counter()
    for run in {(r["i"], r["j"]) for r in runs}:
        inside = [r for r in runs if (r["i"], r["j"]) == run]
        for x in inside:
            for y in inside:
                if x["id"] < y["id"] and x["root"] != y["root"] and (run[0] == run[1] or x["block"] != y["block"]):
                    met[x["id"], y["id"]] += 1
    want = [(i, j) for i in range(30) for j in range(i + 1, 30) if i >= 17 or j >= 17]
    assert set(met) == set(want) and set(met.values()) == {1}


@pytest.mark.parametrize("few", [1000, 5])
def test_components_of_a_hot_centre_and_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = [(1, k) for k in range(100, 700)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 7), (2, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in [1, 2, *range(100, 700)]}, **{1000 + k: 1000 for k in range(41)}}


def test_near_duplicates_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert rows(neardup.link(df), "doc_id", "component_id", "kept") == [(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)]
    assert neardup.dedupe(df).count() == 2
    assert neardup.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_token_files(spark, docs, which):
    df = odd(spark) if which == "odd" else docs
    path = entries.tokenizer_path()
    want = brute.tokens([tuple(r) for r in df.select("doc_id", "text").collect()], Tokenizer.from_file(public_tokenizers.path(entries.TOKENIZER)))
    got = tokenfiles.encode(df, path, shard_bytes=20_000)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_token_files_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(3, "b"), (3, "a"), (None, None), (1, "c"), (3, "b")], "doc_id long, text string")
    got = sorted(tokenfiles.encode(df, entries.tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (1, 1, 2), (3, 3, 2), (3, 5, 2), (3, 7, 2)]
    assert tokenfiles.encode(df.limit(0), entries.tokenizer_path()).count() == 0


def test_token_files_by_key(spark, docs):
    path = scratch.new_dir(spark, "tokens")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(entries.TOKENIZER))
    tokenfiles.write(docs.unionByName(docs.limit(3)), path, entries.tokenizer_path(), shard_bytes=20_000)
    for r in docs.limit(20).collect():
        assert tokenfiles.get(spark, path, r["doc_id"]).tolist() == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    assert tokenfiles.get(spark, path, 10**12) is None and tokenfiles.get(spark, path, None) is None
    starts = lambda: sorted(tuple(r) for r in tokenfiles.encode(docs.unionByName(docs.limit(3)).repartition(5), entries.tokenizer_path(), shard_bytes=20_000).collect())
    assert starts() == starts()


def test_ranks():
    rng = np.random.default_rng(8)
    for n in (1, 63, 64, 511, 512, 513, 5000):
        marks = rng.random(n) < 0.4
        level = tokenfiles.Level.of(marks)
        at = np.arange(n)
        assert (level.test(at) == marks).all() and (level.rank(at) == np.cumsum(marks) - marks).all() and level.ones == marks.sum()


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 50_000))
    levels = tokenfiles.build_hash(keys)
    slots = tokenfiles.hash_slots(levels, keys)
    assert sorted(slots) == list(range(len(keys)))
    shard = tokenfiles.Shard(tokenfiles.pack(keys, np.full(len(keys), 1), np.arange(len(keys), dtype="<u4").tobytes(), 4))
    pick = keys[[5, 4999, 123]]
    assert [shard.document(r)[0] for r in shard.lookup(pick)] == [5, 4999, 123]
    assert (shard.lookup(keys + 1)[~np.isin(keys + 1, keys)] == -1).mean() > 0.999


def test_mix(spark):
    big = "w " * 50
    made = [(i, big, f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(900, None, "z"), (901, "", "z"), (None, "a b", "s0"), (7, "a b", "s0"), (7, "a b", "s0")]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in made], "doc_id long, text string, source string, key string, target double")
    plan = mixing.plan(df).toPandas()
    assert len(plan) == len(made) and (plan["taken"] <= 2 * plan["size"]).all()
    by = plan.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), source_size=("source_size", "first"))
    assert abs(by["target"].sum() - 1.5 * plan["size"].sum()) < 1e-6
    assert ((by["target"] - by["taken"]).abs() <= 100).all() and (by["target"] <= 2 * by["source_size"] + 1e-9).all()
    assert by.loc["z", "taken"] == 0
    again = mixing.plan(df.repartition(7)).toPandas()
    assert sorted(map(str, plan.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.plan(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == plan["times"].sum()


def test_mix_takes_what_the_plan_takes_of_repeated_rows(spark):
    made = [(5, "a b c", "s", "x")] * 300 + [(5, "a b d", "s", "x")] * 200 + [(6, "a b c", "t", "y")] * 100 + [(i, "w " * 7, "u", None) for i in range(50)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, lang string")
    want = mixing.plan(df).groupBy("doc_id", "source", "text_key").sum("times").toPandas()
    want = {(r.doc_id, r.source, r.text_key): r[4] for r in want.itertuples() if r[4]}
    got = mixing.mix(df).withColumn("k", F.xxhash64("text")).groupBy("doc_id", "source", "k").count().collect()
    assert {tuple(r)[:3]: r["count"] for r in got} == want
