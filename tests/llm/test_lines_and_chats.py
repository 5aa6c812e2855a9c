import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlake.llm import linechunks, perspectives

BLOCK = [f"shared line number {k}" for k in range(30)]


def docs(spark):
    made = [
        (1, "\n".join(["a", *BLOCK, "b"])),
        (2, "\n".join(["other", "start", *BLOCK])),
        (3, "\n".join([*BLOCK, *BLOCK])),
        (4, None),
        (5, ""),
        (6, "one line"),
        (7, "one line"),
        (8, "x\n\n\ny\n"),
        (None, "\n".join([*BLOCK, "last"])),
        (9, "q " * 100_000),
        (9, "another text of nine"),
    ]
    return spark.createDataFrame([(*r, "z", 1) for r in made], "doc_id long, text string, idx string, h int"), made


def brute(made):
    """The chunks of each text by the same rule, first occurrences kept, in doc_id order (null last)."""
    import hashlib

    def chunks(text):
        lines, out, at = text.split("\n"), [], 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        for i in range(len(lines)):
            rolled = ((h[i - 1] if i else 0) % linechunks.MODULUS * linechunks.FACTOR + h[i]) % linechunks.MODULUS
            if i == len(lines) - 1 or rolled % linechunks.DIVISOR == 0:
                out.append(lines[at : i + 1])
                at = i + 1
        return out

    seen, out = set(), []
    for doc, text in sorted(made, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((doc, 0, None))
            continue
        kept, gone = [], 0
        for c in chunks(text):
            key = "\n".join(c)
            if len(c) >= linechunks.MIN_LINES and key in seen:
                gone += 1
                continue
            seen.add(key)
            kept += c
        out.append((doc, gone, "\n".join(kept)))
    return out


def test_line_chunks(spark):
    df, made = docs(spark)
    got = [(r["doc_id"], r["removed_chunks"], r["text"]) for r in linechunks.dedupe(df).collect()]
    assert sorted(got, key=str) == sorted(brute(made), key=str)
    assert sum(g[1] for g in got) > 5


def test_boundaries_resist_shifts(spark):
    df, _ = docs(spark)
    by = defaultdict(set)
    for r in linechunks.chunks(df.where("doc_id in (1, 2)")).collect():
        by[r["doc_id"]].add(r["body"])
    assert len(by[1] & by[2]) >= len(by[1]) - 3


def test_line_chunks_empty_and_repeated(spark):
    df, _ = docs(spark)
    assert linechunks.dedupe(df.limit(0)).count() == 0
    one = df.where("doc_id = 1")
    assert {r["text"] for r in linechunks.dedupe(one.unionAll(one)).collect()} == {one.first()["text"]}


def test_line_chunks_of_one_hash(spark, monkeypatch):
    """Unlike chunks that share a hash and length are told apart by their bytes, and repeats among them go."""
    hashed = linechunks._hashed
    monkeypatch.setattr(linechunks, "_hashed", lambda d: hashed(d).withColumns({"h": F.lit(1), "len": F.lit(1)}))
    df, made = docs(spark)
    got = [(r["doc_id"], r["removed_chunks"], r["text"]) for r in linechunks.dedupe(df).collect()]
    assert sorted(got, key=str) == sorted(brute(made), key=str)


def brute_passages(made):
    """Lines of every pair of neighbouring lines that came before (not overlapping its first place) are dropped."""
    seen, out = {}, []
    for n, (doc, text) in enumerate(sorted(made, key=lambda r: (r[0] is None, r[0] or 0))):
        lines, gone = [] if text is None else text.split("\n"), set()
        for i in range(len(lines) - 1):
            at = seen.setdefault((lines[i], lines[i + 1]), (n, i))
            if at not in ((n, i), (n, i - 1)):
                gone |= {i, i + 1}
        out.append((doc, len(lines), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_line_passages(spark):
    made = [(d, t) for d, t in docs(spark)[1] if d != 9]
    for n in range(2, 7):  # passages of 2 to 6 lines, each in three documents amid lines of their own
        passage = [f"passage {n} line {i} " + "word " * 26 for i in range(n)]
        made += [(100 * n + k, "\n".join([f"head {n} {k}", f"more {n} {k}", *passage, f"tail {n} {k}"])) for k in range(3)]
    made += [(1000, "a\na\na\na\na"), (1001, "u\nv\nu\nv"), (1002, "u\nv"), (1003, "x\n\n\ny\n")]
    df = spark.createDataFrame([(*r, "z") for r in made], "doc_id long, text string, idx string")
    got = {r["doc_id"]: tuple(r) for r in linechunks.dedupe_passages(df).select("doc_id", "n_lines", "removed_lines", "text").collect()}
    assert sorted(got.values(), key=str) == brute_passages(made)
    assert all(got[100 * n + k][2] == (n if k else 0) for n in range(2, 7) for k in range(3))
    left = {r["doc_id"]: r["removed_lines"] for r in linechunks.dedupe(df).collect()}
    assert any(left[100 * n + 1] < n for n in range(2, 7))  # what chunks miss
    assert linechunks.dedupe_passages(df.limit(0)).count() == 0
    assert {r["text"] for r in linechunks.dedupe_passages(df.unionAll(df)).where("doc_id = 200").collect()} == {made[[m[0] for m in made].index(200)][1]}


def test_line_passages_of_one_hash(spark, monkeypatch):
    pairs = linechunks._pairs
    monkeypatch.setattr(linechunks, "_pairs", lambda d: pairs(d).withColumn("h", F.when(F.col("len") == 8, 0).otherwise(F.col("h"))))
    made = [(1, "abcd\nefgh\nx"), (2, "ijkl\nmnop\ny"), (3, "abcd\nefgh\nz"), (4, "long line\nof two\nu"), (5, "long line\nof two\nw"), (None, None)]
    got = {r["doc_id"]: r["text"] for r in linechunks.dedupe_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {**dict(made), 5: "w"}


def test_perspectives(spark):
    made = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é!"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, None, "y"), (3, 600, "bob", "z"), (3, 600, "bob", "z")]
    df = spark.createDataFrame([(*r, "k") for r in made], "conv_id long, turn long, role string, text string, part string")
    rows = {(r["conv_id"], r["perspective"]): r for r in perspectives.rotate(df).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "unknown"), (3, "bob")}
    r = rows[1, "ann"]
    assert r["text"] == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\né!<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["hi", "é!"] and (r["n_turns"], r["n_marked"]) == (4, 2)
    assert rows[1, "bob"]["n_marked"] == 1 and rows[3, "bob"]["n_turns"] == 3
    assert rows[3, "unknown"]["text"].endswith("<|assistant|>\ny<|end|>\n")
    assert perspectives.rotate(df.limit(0)).count() == 0


def brute_perspectives(made):
    out, people = [], defaultdict(set)
    made = [(c, t, r or "unknown", x or "") for c, t, r, x in made]
    for c, _, r, _ in made:
        people[c].update({r} - {"system"})
    for c, names in people.items():
        turns = sorted((r for r in made if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        for me in names:
            text, mask = "", []
            for _, _, who, said in turns:
                said = re.sub(r"<(\\*)\|", r"<\1\\|", said)
                name = who.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A")
                text += "<|assistant|>\n" if who == me else "<|system|>\n" if who == "system" else f"<|user name={name}|>\n"
                if who == me:
                    mask.append((len(text), len(text) + len(said)))
                text += said + "<|end|>\n"
            out.append((c, me, len(turns), len(mask), text, mask))
    return sorted(out, key=str)


def test_long_dialogues_are_whole(spark):
    """600 and 10,000 turns, many turns without a number or with the same one, and texts and names that look like marks."""
    made = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(600)]
    made += [(2, 0, "system", "context")] + [(2, i, ["u", "v", "w"][i * i % 3], f"é{i} <|end|>") for i in range(1, 10_000)]
    made += [(3, None, "x|>y\n%", f"{k} <\\|x<|") for k in range(700)] + [(3, 5, "system", "same") for _ in range(600)] + [(3, 5, None, None)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    got = [(*tuple(r)[:5], [tuple(m) for m in r["mask"]]) for r in perspectives.rotate(df).collect()]
    assert sorted(got, key=str) == brute_perspectives(made)
