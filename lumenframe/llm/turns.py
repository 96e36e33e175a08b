"""Conversation structure repair by a fold over each conversation's turns.

Windows over a conversation flag its faults; its turns, sorted, are one array, which ``aggregate`` folds into four (cost, audit) structs, one for each
state of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.  ``least`` takes the cheapest way into a state, at equal cost the smallest audit.
Two ways of equal cost into one state never have audits of which one begins the other (the longer one's further letters would all be insertions that
lead back to the state, at a cost), so the least of prefixes leads to the least of whole audits.  A third field of the structs notes what becomes of
each turn, from which the repaired conversation is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an edit costs: a new role, a deletion, an insertion, a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_NEVER = 1 << 50
_WORD = r"[^\x20\x09-\x0D]"


def damaged(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the turn (``gone``; the row stays, so that its conversation does), 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role "user".  Null roles and texts are one space, and null ids and turns count as one space in the hash, but stay null.
    """
    t = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.withColumn("r", F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20)
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("r") == 0).alias("gone"), "r")
    return t.withColumn("again", F.explode(F.expr("sequence(1, if(r = 3, 2, 1))"))).drop("r", "again")


def flagged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with their place in the conversation, first fault, and whether they break the order of roles or repeat a turn's number.

    Turns go by number, nulls first, ties by role and text; those that are gone come last and have no flags.
    """
    w = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    core = F.regexp_extract("text", rf"(?s)({_WORD})[\x20\x09-\x0D]*\z", 1)
    here = ~F.col("gone")
    pair = F.concat(F.lag(initial).over(w), initial)
    t = turns.withColumn("place", F.row_number().over(w)).withColumn("initial", initial).withColumn("core", core)
    t = t.withColumn("illegal", here & F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    t = t.withColumn("new_turn", here & F.col("turn").isNotNull() & F.coalesce(F.lag("turn").over(w) != F.col("turn"), F.lit(True)))
    t = t.withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("gone"), None).when(F.col("core") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("core").isin(".", "!", "?"), "truncated").otherwise("none")
    return t.select("conv_id", "turn", "role", "text", "gone", "place", "initial", "illegal", "new_turn", fault.alias("fault"))


def _way(cost, audit: str, shape: str, of: Column) -> Column:
    return F.struct((of["cost"] + cost).alias("cost"), F.concat(of["audit"], F.lit(audit)).alias("audit"), F.concat(of["shape"], shape if isinstance(shape, Column) else F.lit(shape)).alias("shape"))


def _states(a: Column, s: Column, u: Column, b: Column) -> Column:
    return F.struct(a.alias("none"), s.alias("s"), u.alias("u"), b.alias("a"))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _inserted(x: Column) -> Column:
    """States after any turns that are put in here; more than two would only lead in a circle."""
    into_u = F.least(x["u"], _way(INSERT, "I", "U", x["none"]), _way(INSERT, "I", "U", x["s"]))
    return _let(into_u, lambda u: _states(x["none"], x["s"], F.least(u, _way(INSERT, "I", "U", x["a"])), F.least(x["a"], _way(INSERT, "I", "A", u))))


def _taken(x: Column, t: Column) -> Column:
    """States after turn t is deleted, kept or given another role."""
    more = F.when(t["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
    barred = F.when(t["must_go"], F.lit(_NEVER)).otherwise(F.lit(0))
    keep = lambda letter, of: _way(F.when(t["initial"] == letter, barred + more).otherwise(F.lit(_NEVER)), "K", "k;", of)
    role = lambda shape, of: _way(barred + more + REROLE, "R", shape, of)
    gone = lambda of: _way(DELETE, "D", "d;", of)
    entries = (x["none"], x["s"], x["a"])
    return _states(
        gone(x["none"]),
        F.least(gone(x["s"]), keep("s", x["none"])),
        F.least(gone(x["u"]), *[keep("u", e) for e in entries], *[role("u;", e) for e in entries]),
        F.least(gone(x["a"]), keep("a", x["u"]), role("a;", x["u"])),
    )


_LINES = """flatten(transform(split(best.shape, ';'), (shape, i) -> transform(filter(split(shape, ''), c -> c NOT IN ('', 'd')),
  c -> CASE c WHEN 'U' THEN 'user:' WHEN 'A' THEN 'assistant:' WHEN 'k' THEN concat(turns[i].role, ':', turns[i].text)
              WHEN 'u' THEN concat('user:', turns[i].text) ELSE concat('assistant:', turns[i].text) END)))"""


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation of ``damaged``-like turns (conv_id, turn, role, text, gone).

    ``repaired`` is the array of ``role:text`` lines after the cheapest edits that give roles by initial as ``(s?(ua)+)?``, at equal cost those with the least
    audit.  A conversation all of whose turns are gone has noughts and no lines; the null conversation is one of its own; no turns, no rows.
    A conversation is folded whole, as its lines are one value: it must fit a row.
    """
    n = lambda c: F.count_if(c).cast("long")
    turn = F.struct("place", "role", "text", "initial", F.col("fault").isin("blank", "duplicate").alias("must_go"), (F.col("fault") == "truncated").alias("truncated"))
    conv = (
        flagged(turns)
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.max(F.when(~F.col("gone"), F.col("turn"))) - F.min(F.when(~F.col("gone"), F.col("turn"))) + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
            *[n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
            n(F.col("illegal")).alias("illegal"),
            F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"),
        )
    )
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("shape"))
    ends = F.aggregate("turns", _states(state(0), *[state(_NEVER)] * 3), lambda x, t: _let(_inserted(x), lambda y: _taken(y, t)), _inserted)
    best = conv.withColumn("ends", ends).withColumn("best", F.least("ends.none", "ends.a"))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.expr(_LINES).alias("repaired"))


def op13_turn_repair(spark, sf_dir):
    """Faults, cheapest repair and its hash of each conversation after ``damaged``; see there and ``repair`` for nulls, ties, repeats and empty tables."""
    r = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return r.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.encode(F.array_join("repaired", "\n"), "UTF-8"), 256).alias("repaired_sha256"))


_CRC = """tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i)))"""
_CRC_OF = "xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT))"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _sql_way(of: str, cost: str, letter: str, shape: str) -> str:
    """A way as text: cost in ten digits, audit, a bar, shape; greater costs are greater texts, and the bar's place is the audit's end."""
    return f"lpad(({of}[1:10]::BIGINT + {cost})::VARCHAR, 10, '0') || split_part({of}[11:], '~', 1) || '{letter}~' || split_part({of}, '~', 2) || {shape}"


def _oracle() -> str:
    # '~' sorts after all letters: a longer audit would come first at equal cost, which only matters between the two end states; there audits are compared alone
    ins = {
        "n": "n", "s": "s",
        "u": _least("u", *[_sql_way(x, "3", "I", "'U'") for x in ("n", "s", "a")]),
        "a": _least("a", _sql_way("u", "3", "I", "'A'"), *[_sql_way(x, "6", "II", "'UA'") for x in ("n", "s")]),
    }
    keep = lambda x, letter: _sql_way(f"from_{x}", f"(CASE WHEN initial = '{letter}' AND NOT must_go THEN 3 * truncated ELSE 100000000 END)", "K", "'k;'")
    role = lambda x, to: _sql_way(f"from_{x}", "(CASE WHEN must_go THEN 100000000 ELSE 3 + 3 * truncated END)", "R", f"'{to};'")
    gone = lambda x: _sql_way(f"from_{x}", "4", "D", "'d;'")
    step = {
        "n": gone("n"),
        "s": _least(gone("s"), keep("n", "s")),
        "u": _least(gone("u"), *[keep(x, "u") for x in "nsa"], *[role(x, "u") for x in "nsa"]),
        "a": _least(gone("a"), keep("u", "a"), role("u", "a")),
    }
    first = lambda cost: f"'{cost:010d}~'"
    return f"""
WITH RECURSIVE {_CRC},
ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
r0 AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF.format("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS r
       FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id, tab),
r1 AS (SELECT k, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN r = 3 THEN 2 ELSE 1 END)) FROM r0 WHERE r <> 0),
r2 AS (SELECT k, turn, role, text, row_number() OVER w AS place, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
              lag(left(role, 1)) OVER w || left(role, 1) AS pair
       FROM r1 WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text)),
r3 AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS dup, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS trunc, body = '' OR nth > 1 AS must_go,
              (body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS truncated
              FROM (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY place) AS nth FROM r2)),
fold AS (SELECT k, 0::BIGINT AS pos, {first(0)} AS n, {first(10**8)} AS s, {first(10**8)} AS u, {first(10**8)} AS a FROM ids
  UNION ALL SELECT k, pos + 1, {step["n"]}, {step["s"]}, {step["u"]}, {step["a"]}
  FROM (SELECT k, pos, {ins["n"]} AS from_n, {ins["s"]} AS from_s, {ins["u"]} AS from_u, {ins["a"]} AS from_a FROM fold) f JOIN r3 USING (k) WHERE r3.place = f.pos + 1),
ends AS (SELECT k, n, {ins["a"]} AS a FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1),
best AS (SELECT k, CASE WHEN n[1:10] < a[1:10] OR (n[1:10] = a[1:10] AND split_part(n[11:], '~', 1) < split_part(a[11:], '~', 1)) THEN n ELSE a END AS w FROM ends),
piece AS (SELECT k, i, j, c FROM (SELECT k, i, unnest(range(len(sh))) AS j, unnest(string_split(sh, '')) AS c FROM (SELECT k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS sh FROM (SELECT k, string_split(split_part(w, '~', 2), ';') AS x FROM best)))),
line AS (SELECT piece.k, string_agg(CASE c WHEN 'U' THEN 'user:' WHEN 'A' THEN 'assistant:' WHEN 'k' THEN role || ':' || text WHEN 'u' THEN 'user:' || text ELSE 'assistant:' || text END, chr(10) ORDER BY i, j) AS body
         FROM piece LEFT JOIN r3 ON r3.k = piece.k AND r3.place = piece.i WHERE c NOT IN ('', 'd') GROUP BY 1),
faults AS (SELECT k, (coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
                  count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r3 GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(faults.truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       w[1:10]::BIGINT AS cost, split_part(w[11:], '~', 1) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN best USING (k) LEFT JOIN faults USING (k) LEFT JOIN line USING (k)"""


ORACLE = _oracle()
