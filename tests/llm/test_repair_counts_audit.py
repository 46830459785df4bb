"""Operators 11 to 13 against brute force, their libraries and SQL, with nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stormgrid.llm import conversation_repair, filter_audit, token_cache
from stormgrid.llm.shared import scratch

SPACED = re.compile("[^\x20\x09-\x0d]+")
counted = collections.Counter


# ---- operator 11


TURNS = "conv_id long, turn long, role string, text string, _turn_there boolean, _turn_copy int, seq long, cost long"


def _faults(rows):
    """rows: (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not SPACED.search(text) else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _brute(rows):
    """The cheapest (cost, audit, lines) over all edits with up to two insertions in a row."""
    faults, best = _faults(rows), None
    gaps = ["", "u", "a", "ua", "au"]
    full = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in faults]):
        base = sum(2 if e == "D" else (0 if e == "K" else 1) + 5 * (f == "truncated") for e, f in zip(edits, faults, strict=True))
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for e, g, (_, role, text) in itertools.zip_longest(edits, ins, rows, fillvalue=(None, None, None)):
                audit += "I" * len(g) + (e if e in ("D", "K") else "R" if e in ("u", "a") else "")
                lines += [full[x] + ":" for x in g]
                if e in ("K", "u", "a"):
                    lines.append((role if e == "K" else full[e]) + ":" + text)
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def _stats(rows):
    f = counted(_faults(rows))
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f["blank"], f["duplicate"], f["truncated"], sum(p not in ("su", "ua", "au") for p in pairs))


def _as_turns(spark, convs):
    data = [(i, t, r, x, True, 0, 0, 0) for i, rows in convs.items() for t, r, x in rows]
    data += [(i, 0, "user", "x.", False, 0, 0, 0) for i, rows in convs.items() if not rows]
    return spark.createDataFrame(data, TURNS)


def test_repair_is_the_cheapest_of_all(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?\n ", "cut off,", "Yes."]
    convs = {}
    for i in range(160):
        rows = [(rng.choice([None, 1, 2, 3, 7]), rng.choice(["user", "assistant", "system", "tool", "User", ""]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        convs[i] = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    got = {r["conv_id"]: r for r in conversation_repair.repaired(_as_turns(spark, convs)).collect()}
    assert set(got) == set(convs)
    for i, rows in convs.items():
        r = got[i]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == _stats(rows)
        assert (r["cost"], r["audit"], r["repaired"]) == _brute(rows), rows


def test_repair_in_blocks_is_the_same(spark):
    rng = random.Random(5)
    convs = {i: [(t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", "c!", f"t{t}."])) for t in range(n)] for i, n in enumerate([1, 2, 3, 4, 7, 12, 40])}
    turns = _as_turns(spark, convs)
    whole = conversation_repair.repaired(turns).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, conversation_repair.repaired(turns, block=3).collect()))
    for r in whole:
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in r["repaired"]))


def _damage(rows):
    """The contract's damage in Python, in order: conversation to (turn, role, text)."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def test_op11_whole(spark):
    rng = random.Random(2)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None]), rng.choice(["One.", "Two!", "three", None, "", "x? y"])) for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows += rows[3:6] + [(1000 + k, 0, "user", "Alone.") for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "rows": F.lit("x"), "cost": F.lit(2)})
    got = {r["conv_id"]: r for r in conversation_repair.op11(df).collect()}
    damaged = _damage(rows)
    assert set(got) == set(damaged) and any(not r for r in damaged.values())
    nothing = hashlib.sha256(b"").hexdigest()
    for c, r in damaged.items():
        assert tuple(got[c])[1:6] == _stats(r)
        if not r:
            assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
        if len(r) <= 3:
            cost, audit, lines = _brute(r)
            assert tuple(got[c])[6:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    con = duckdb.connect()
    con.register("_t", df.select("conv_id", "turn", "role", "text").toArrow())
    con.execute("create table conversations as select * from _t")
    want = con.execute(conversation_repair.ORACLE).fetchall()
    assert sorted(want, key=str) == sorted(map(tuple, got.values()), key=str)
    assert conversation_repair.op11(df.limit(0)).count() == 0


# ---- operator 12


DOCS = "doc_id long, text string, source string, digest string, n_tokens int"


def _texts():
    rng = random.Random(12)
    words = ["storm", "über", "l'été", "can't", "42", "²½", "x" * 90, "漢字", "٣", "🙂", "Ⅷ", "ʰ", "<|endoftext|>", "՘", "\x1c", "\x85", " ", " ", "a‍b"]
    out = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", ""]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*out, None, "", " ", "\n\n ", out[0], out[0], "word " * 60_000, "<|endoftext|>", "plain text, only ASCII; it's fine. " * 40]


def _want(texts, path):
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(m.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    import public_tokenizers as P

    texts, path, cache = _texts(), P.path(name), scratch(spark, "cache")
    rows = [(i, t, "s", "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", "clash", 1), (3, texts[3], "s", "clash", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    n = _want([r[1] for r in rows], path)
    want = counted((r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True))
    assert counted(map(tuple, token_cache.counted(df, cache, path).collect())) == want


def test_only_distinct_misses_are_encoded_and_appended(spark, monkeypatch):
    cache, path = scratch(spark, "cache"), token_cache.default_path()
    asked = []
    encode = token_cache._encoded
    monkeypatch.setattr(token_cache, "_encoded", lambda texts, p: asked.append(sorted(r["text"] for r in texts.collect())) or encode(texts, p))
    first = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two"), (4, None), (5, "")], "doc_id long, text string")
    token_cache.counted(first, cache).collect()
    assert asked == [["", "one", "two"]]
    again = token_cache.counted(first.unionByName(spark.createDataFrame([(6, "three"), (7, "three")], "doc_id long, text string")), cache).collect()
    assert asked[1:] == [["three"]] and len(again) == 7
    token_cache.counted(first, cache).collect()
    assert len(asked) == 2
    of = token_cache.version(path)
    assert token_cache.stored(spark, cache, of).count() == 4 and token_cache.stored(spark, cache, "other").count() == 0
    token_cache.append(token_cache.stored(spark, cache, of), cache, of)  # as of two calls at a time
    assert len(token_cache.counted(first, cache).collect()) == 5 and len(asked) == 2
    monkeypatch.setattr(token_cache, "FEW", 0)  # misses too many to be broadcast
    more = spark.createDataFrame([(8, "four"), (9, "four"), (10, "five"), (1, "one")], "doc_id long, text string")
    assert len(token_cache.counted(more, cache).collect()) == 4 and asked[2] == ["five", "four"]
    assert token_cache.counted(first.limit(0), scratch(spark, "cache")).count() == 0


# ---- operator 13


def _audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > least[t]), strict=True) if x}
        docs.append((s or "", fails, i in good, i in toxic))
    out, sums = [], counted()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                cut = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                gone += cut
                left = [d for d in left if f not in d[1]]
                sums[part, f] += len(cut)
                out.append((part, order, step, len(left), len(cut), redundant, sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in cut), sum(d[3] for d in cut)))
    return counted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(13)
    text = lambda n, k: " ".join(rng.choice(["Aa", "b", "c", "D", "e$"][: 2 + k]) + str(rng.randrange(1 + 90 * k)) for _ in range(n))
    texts = [text(rng.choice([3, 150, 199, 200, 260]), k) for k in (0, 1, 2, 3) for _ in range(12)]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["x", "y", "", None])) for _ in range(150)]
    rows += [(200 + i, "the same everywhere", "x") for i in range(80)] + [(i, None, "y") for i in (7, 8)] + [(9, "", "y"), (None, texts[0], "x"), (None, None, None), (500, "#", "y"), (500, "#", "y"), (501, "#", "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (None, 1, 1)]
    return rows, labels


def test_filter_audit(spark, audit_rows):
    rows, labels = audit_rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit("m"), "words": F.lit(0), "fp": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(1), "text": F.lit("t")})
    want = _audit(rows, labels)
    assert counted(map(tuple, filter_audit.audited(df.repartition(4), lab).collect())) == want
    # all fingerprints equal: chains of different texts; nothing held in a task; one partition's worth of text a few bytes
    for how in ({"fingerprint": lambda t: F.lit(7).cast("long") + 0 * F.length(t)}, {"held": 0, "routed": 500}):
        assert counted(map(tuple, filter_audit.audited(df.repartition(5), lab, **how).collect())) == want
    assert filter_audit.audited(df.limit(0), lab).count() == 0
    no_labels = counted(map(tuple, filter_audit.audited(df, lab.limit(0)).collect()))
    assert no_labels == _audit(rows, [])


def test_copies_and_sql(spark, audit_rows):
    rows, labels = audit_rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    assert counted(r[0] for r in filter_audit.copies(df).collect()) == counted(i for i, t, _ in rows if i is not None and i > least[t or ""])
    con = duckdb.connect()
    con.register("_d", df.where("doc_id IS NOT NULL").toArrow())
    con.register("_l", spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toArrow())
    con.execute("create table documents as select * from _d")
    con.execute("create table labels as select * from _l")
    want = counted(con.execute(filter_audit.ORACLE).fetchall())
    assert counted(map(tuple, filter_audit.audited(df.where("doc_id IS NOT NULL"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())) == want


def test_cleaned_with_a_column_named_like_its_flag(spark):
    from stormgrid.llm import chain_dedup

    words = [f"w{i}" for i in range(400)]
    passage = " ".join(words[:60])
    rows = [(1, passage + " " + " ".join(words[100:140]), True, 7), (2, " ".join(words[200:240]) + " " + passage, None, 8), (3, None, False, 9), (4, "", True, 1)]
    got = {r["doc_id"]: r for r in chain_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, _null boolean, n_chars long")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"].strip() == " ".join(words[200:240]) and got[3]["text"] is None and got[4]["text"] == ""
    assert [got[i]["_null"] for i in (1, 2, 3, 4)] == [True, None, False, True] and got[2]["n_chars"] == len(got[2]["text"])
