"""Operator 11: the cheapest repair of each conversation's turns, as a fold in Spark SQL. Only DataFrame functions run.

Windows over a conversation give each turn its first fault and its place. The sorted turns are folded by aggregate():
the roles kept so far leave one of four states (nothing, system, user, assistant), and for each the fold carries the
cheapest edits that lead there as a struct (cost, audit). least() over such structs takes the smaller cost and, of equal
costs, the smaller audit. That is enough to find the least audit of all: of two edits of the same turns at equal cost,
none is the beginning of the other (insertions cost), so what follows doesn't change their order.

Inside the fold, I and J stand for an inserted user and assistant, R and S for a turn given the role user and assistant;
the state before decides which, so the order of audits is that of the letters I and R that come out.

Audits grow with the conversation, and every step copies them. Conversations of more than BLOCK turns are therefore cut
into blocks: each is folded from all four states, and the blocks' four by four structs are chained. A conversation's
audit and digest are values of one row, so one task holds its turns; windows spill, the array of its turns doesn't.

Edge cases: null role and text are one space, which makes such a turn blank. Null turns come first. Turns equal in number
are taken by role, then text. A null conv_id is a conversation of its own. Repeated rows are duplicates. A conversation
without rows after damage has zeros, no audit and the digest of nothing. Empty table: empty result. Other columns are not
looked at; names that begin with _turn_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.llm.shared import project

#: Turns folded in one go.
BLOCK = 256
RETYPE, REMOVE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
STATE = "struct<cost:bigint,audit:string>"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, _turn_there, _turn_copy): rows after damage by a digest of conversation and turn. What is
    dropped stays, as not there, so that its conversation is known."""
    d = project(turns, "conv_id", "turn", "role", "text")
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    d = d.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("_turn_there"), F.explode(twice).alias("_turn_copy"))


def flagged(turns: DataFrame) -> DataFrame:
    """Each turn's place and first fault. All windows are within a conversation, so they share one shuffle."""
    inside = ["conv_id", "_turn_there"]
    order = Window.partitionBy(*inside).orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_turn_copy")
    d = turns.withColumns({"_turn_seq": F.row_number().over(order), "_turn_before": F.lag("turn").over(order), "_turn_pair": F.concat(F.lag(F.substring("role", 1, 1)).over(order), F.substring("role", 1, 1))})
    seen = F.row_number().over(Window.partitionBy(*inside, "role", "text").orderBy("_turn_seq")) > 1
    shown = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(shown) == 0, "blank").when(seen, "duplicate").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated")
    return d.withColumn("_turn_fault", fault)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _plus(s: Column, cost: Column | int, letters: str) -> Column:
    return F.struct((s["cost"] + cost).alias("cost"), F.concat(s["audit"], F.lit(letters)).alias("audit"))


def _inserted(a: Column) -> Column:
    """After any insertions: none leads to s0 and s1, and two in a row are useful from there only."""
    s0, s1, s2, s3 = (a[f"s{i}"] for i in range(4))
    user = F.least(s2, *(_plus(s, INSERT, "I") for s in (s0, s1, s3)))
    assistant = F.least(s3, _plus(s2, INSERT, "J"), *(_plus(s, 2 * INSERT, "IJ") for s in (s0, s1)))
    return F.struct(s0.alias("s0"), s1.alias("s1"), user.alias("s2"), assistant.alias("s3"))


def _step(a: Column, turn: Column) -> Column:
    """A turn is deleted, kept in its role, or given the role that fits. turn: (stay, initial), stay the cost of keeping."""
    stay = turn["stay"]
    keep = lambda s, initial: _plus(s, stay + F.when(turn["initial"] == initial, 0).otherwise(NEVER), "K")

    def then(c: Column) -> Column:
        s0, s1, s2, s3 = (c[f"s{i}"] for i in range(4))
        gone = lambda s: _plus(s, REMOVE, "D")
        user = F.least(gone(s2), *(x for s in (s0, s1, s3) for x in (keep(s, "u"), _plus(s, stay + RETYPE, "R"))))
        assistant = F.least(gone(s3), keep(s2, "a"), _plus(s2, stay + RETYPE, "S"))
        return F.struct(gone(s0).alias("s0"), F.least(gone(s1), keep(s0, "s")).alias("s1"), user.alias("s2"), assistant.alias("s3"))

    return _let(_inserted(a), then)


def _start(k: int) -> Column:
    return F.struct(*(F.struct(F.lit(0 if i == k else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"s{i}") for i in range(4)))


def _fold(turns: Column, k: int = 0) -> Column:
    return F.aggregate(turns, _start(k), _step)


def _chained(turns: Column, block: int) -> Column:
    """As _fold, block by block."""
    cuts = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / block).cast("int"))
    parts = F.transform(cuts, lambda i: F.slice(turns, i * block + 1, F.lit(block)))
    tables = F.transform(parts, lambda p: F.array(*(_fold(p, k) for k in range(4))))

    def join(a: Column, m: Column) -> Column:
        def end(e: str) -> Column:
            return F.least(*(F.struct((a[f"s{k}"]["cost"] + m[k][e]["cost"]).alias("cost"), F.concat(a[f"s{k}"]["audit"], m[k][e]["audit"]).alias("audit")) for k in range(4)))

        return F.struct(*(end(f"s{i}").alias(f"s{i}") for i in range(4)))

    return F.aggregate(tables, _start(0), join)


def _lines(rows: Column, audit: Column) -> Column:
    """The repaired turns as role:text, by the letters before and for each row and those after the last."""
    added = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x.isin("I", "J")), lambda x: F.when(x == "I", "user:").otherwise("assistant:"))

    def row(r: Column, letters: Column) -> Column:
        last = F.substring(letters, -1, 1)
        role = F.when(last == "K", r["role"]).when(last == "R", "user").otherwise("assistant")
        own = F.when(last == "D", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.concat(role, F.lit(":"), r["text"])))
        return F.concat(added(letters), own)

    by_row = F.zip_with(rows, F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0)), row)
    return F.concat(F.flatten(by_row), added(F.regexp_extract(audit, "[IJ]*$", 0)))


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role:text). turns: conv_id, turn,
    role, text, none of the last two null, and _turn_there, _turn_copy as of `damaged`."""
    d = flagged(turns)
    there = F.col("_turn_there")
    stay = F.when(F.col("_turn_fault").isin("blank", "duplicate"), NEVER).when(F.col("_turn_fault") == "truncated", TRUNCATED).otherwise(0).cast("long")
    row = F.struct(F.col("_turn_seq").alias("seq"), stay.alias("stay"), F.substring("role", 1, 1).alias("initial"), "role", "text")
    number = F.when(there, F.col("turn"))
    new = number.isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn_before"))
    g = d.groupBy("conv_id").agg(
        F.coalesce(F.max(number) - F.min(number) + 1 - F.count_if(new), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(there & (F.col("_turn_fault") == x)).alias(x) for x in ("blank", "duplicate", "truncated")),
        F.count_if(there & F.col("_turn_pair").isNotNull() & ~F.col("_turn_pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(there, row))).alias("rows"))
    steps = F.transform("rows", lambda r: F.struct(r["stay"].alias("stay"), r["initial"].alias("initial")))
    folded = F.when(F.size("rows") <= block, _fold(steps)).otherwise(_chained(steps, block))
    g = g.withColumn("best", _let(folded, lambda a: _let(_inserted(a), lambda c: F.least(c["s0"], c["s3"]))))
    return g.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate("best.audit", "JS", "IR").alias("audit"), _lines(F.col("rows"), F.col("best.audit")).alias("repaired"))


def op11(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    r = repaired(damaged(turns), block)
    return r.withColumn("repaired_sha256", F.sha2(F.array_join("repaired", "\n"), 256)).drop("repaired")


def _sql_plus(s: str, cost: str, letters: str) -> str:
    return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letters}'}}"


def _oracle() -> str:
    """The same steps as a recursive query, one turn of every conversation a round."""
    least = lambda *x: "list_min([" + ", ".join(x) + "])"
    closed = f"""s0, s1, {least("s2", *(_sql_plus(s, "5", "I") for s in ("s0", "s1", "s3")))} AS s2,
    {least("s3", _sql_plus("s2", "5", "J"), *(_sql_plus(s, "10", "IJ") for s in ("s0", "s1")))} AS s3"""
    keep = lambda s, i: _sql_plus(s, f"stay + CASE WHEN initial = '{i}' THEN 0 ELSE {NEVER} END", "K")
    user = least(_sql_plus("s2", "2", "D"), *(x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), _sql_plus(s, "stay + 1", "R"))))
    assistant = least(_sql_plus("s3", "2", "D"), keep("s2", "a"), _sql_plus("s2", "stay + 1", "S"))
    zero = lambda cost: f"{{'c': CAST({cost} AS BIGINT), 'a': ''}}"
    return rf"""
WITH RECURSIVE bits(n, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) x(i) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
k0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k1 AS (SELECT k0.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM k0, crc),
k2 AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM k1, range(2) x(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
conv AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
k3 AS (SELECT id, turn, role, text, role[1:1] AS initial, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS seq
  FROM k2 JOIN conv ON k2.conv_id IS NOT DISTINCT FROM conv.conv_id),
k4 AS (SELECT *, lag(initial) OVER (PARTITION BY id ORDER BY seq) || initial AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY seq) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM k3),
k5 AS (SELECT *, CAST(CASE WHEN fault IN ('blank', 'duplicate') THEN {NEVER} WHEN fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT) AS stay FROM k4),
fold(id, seq, s0, s1, s2, s3) AS (SELECT id, CAST(0 AS BIGINT), {zero(0)}, {zero(NEVER)}, {zero(NEVER)}, {zero(NEVER)} FROM conv UNION ALL
  SELECT id, seq, {_sql_plus("s0", "2", "D")}, {least(_sql_plus("s1", "2", "D"), keep("s0", "s"))}, {user}, {assistant}
  FROM (SELECT k5.id, k5.seq, stay, initial, {closed} FROM fold JOIN k5 ON k5.id = fold.id AND k5.seq = fold.seq + 1)),
ends AS (SELECT id, {least("s0", "s3")} AS best FROM (SELECT id, {closed} FROM fold WHERE seq = (SELECT max(f.seq) FROM fold f WHERE f.id = fold.id))),
segs AS (SELECT id, unnest(regexp_extract_all(best.a, '[IJ]*[DKRS]')) AS seg, unnest(range(1, 1 + len(regexp_extract_all(best.a, '[IJ]*[DKRS]')))) AS seq FROM ends),
said AS (SELECT id, seq, replace(replace(regexp_replace(seg, '[DKRS]', ''), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10))
  || CASE seg[-1] WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN 'user:' || text || chr(10) ELSE 'assistant:' || text || chr(10) END AS part
  FROM segs JOIN k5 USING (id, seq)
  UNION ALL SELECT id, {NEVER}, replace(replace(regexp_extract(best.a, '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) FROM ends),
told AS (SELECT id, string_agg(part, '' ORDER BY seq) AS doc FROM said GROUP BY id),
stat AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k5 GROUP BY id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, translate(best.a, 'JS', 'IR') AS audit, sha256(doc[1:-2]) AS repaired_sha256
FROM conv JOIN ends USING (id) JOIN told USING (id) LEFT JOIN stat USING (id)
"""


ORACLE = _oracle()
