"""Conversation structure repair: faults by row, cheapest edits over the lattice of rows and roles, repaired turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import stored
from hirelens.llm.crc_sql import CRC_TABLE, crc32_sql
from hirelens.llm.lattice import LEGAL_ENDS, compose, matrix, solve, write

#: A conversation is solved in stretches of so many rows or bytes at most, joined by their matrices.
STRETCH_ROWS, STRETCH_BYTES = 64, 1 << 22
#: Stretches joined at once.
FAN_IN = 16
#: Role initials that may follow each other, white space, and what ends a whole text.
FOLLOWS, BLANKS, STOPS = ("su", "ua", "au"), " \t\n\v\f\r", ".!?"
TURNS = "array<struct<role:string,text:string,times:long>>"
EDGES = "array<struct<a:int,b:int,cost:long,letters:string>>"
SUMS = "blank long, duplicate long, truncated long, illegal long, distinct long, first_role string, last_role string, low long, high long, rows long"


def _or_blank(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text) after damage drawn from the row's own number, crc32 of `id:turn` mod 20; nulls are one blank.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks,
    3 repeats it, 4 makes its role `user`; other rows stay as they are.
    """
    fault = F.crc32(F.concat(_or_blank(id_col), F.lit(":"), _or_blank(turn_col))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_or_blank(text_col), "[.!?]", "")).otherwise(_or_blank(text_col))
    role = F.when(fault == 4, "user").otherwise(_or_blank(role_col))
    times = F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter(fault != 0).select(id_col, turn_col, role.alias(role_col), text.alias(text_col), times.alias("_time")).drop("_time")


class _Stretch:
    """Rows of one conversation that follow each other, as they are read."""

    def __init__(self, key):
        self.key, self.code, self.turns, self.bytes = key, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.rows = 0
        self.first_role = self.last_role = self.low = self.high = None

    def add(self, turn, role: str, text: str, times: int, seen: bool) -> None:
        said = text.rstrip(BLANKS)
        initial, stays = role[:1], said and not seen
        if not said:
            self.blank += times
        else:
            self.duplicate += times - 1 if stays else times
        if stays:
            short = said[-1] not in STOPS
            self.truncated += short
            self.code += [(initial, short)] + ([times - 1] if times > 1 else [])
        elif self.code and isinstance(self.code[-1], int):
            self.code[-1] += times
        else:
            self.code.append(times)
        self.turns.append({"role": role if stays else None, "text": text if stays else None, "times": times})
        self.bytes += len(text) if stays else 0
        self.illegal += times - 1
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in FOLLOWS
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        if turn is not None and (self.high is None or turn != self.high):
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows += times

    def full(self) -> bool:
        return len(self.turns) >= STRETCH_ROWS or self.bytes >= STRETCH_BYTES

    def sums(self) -> dict:
        return {name: getattr(self, name) for name in ("blank", "duplicate", "truncated", "illegal", "distinct", "first_role", "last_role", "low", "high", "rows")}


def _solved(stretch: _Stretch) -> dict:
    cost, letters = solve(tuple(stretch.code))
    turns = [{"role": role, "text": text, "times": 1} for role, text in write(letters, 0, [(t["role"], t["text"], t["times"]) for t in stretch.turns])]
    return {"id": stretch.key, "piece": 0, "whole": True, **stretch.sums(), "cost": cost, "audit": letters, "edges": None, "turns": turns}


def _open(stretch: _Stretch, piece: int) -> dict:
    edges = [{"a": a, "b": b, "cost": c, "letters": s} for a, b, c, s in matrix(tuple(stretch.code))]
    return {"id": stretch.key, "piece": piece, "whole": False, **stretch.sums(), "cost": None, "audit": None, "edges": edges, "turns": stretch.turns}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows in order, cut into stretches. A conversation within one stretch is solved at once, unless it meets an end of the range of rows."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId() << 32
    held, alone, first = None, True, True
    for batch in batches:
        for key, turn, role, text, times, seen in zip(*(column.to_pylist() for column in batch.columns)):
            if held is not None and held.key != key:
                if alone and not first:
                    yield _solved(held)
                else:
                    yield _open(held, piece)
                    piece += 1
                held, alone, first = None, True, False
            elif held is not None and held.full():
                yield _open(held, piece)
                piece += 1
                held, alone = None, False
            if held is None:
                held = _Stretch(key)
            held.add(turn, role, text, times, seen)
    if held is not None:
        yield _open(held, piece)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _joined(parts: list[dict]) -> dict:
    """The sums and the matrix of stretches that follow each other."""
    out = dict(parts[0])
    for part in parts[1:]:
        for name in ("blank", "duplicate", "truncated", "rows"):
            out[name] += part[name]
        out["illegal"] += part["illegal"] + (out["last_role"] + part["first_role"] not in FOLLOWS)
        same = out["high"] is not None and out["high"] == part["low"]
        out["distinct"] += part["distinct"] - same
        out["last_role"] = part["last_role"]
        out["low"] = part["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if part["high"] is None else part["high"]
    if len(parts) > 1:
        edges = compose([[(e["a"], e["b"], e["cost"], e["letters"]) for e in part["edges"]] for part in parts])
        out["edges"] = [{"a": a, "b": b, "cost": c, "letters": s} for a, b, c, s in edges]
    return out


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    arrow = _arrow(schema)
    return df.mapInArrow(lambda batches: _batches(make(batches), arrow), schema)


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): a row of faults and edits for each conversation, and its repaired turns.

    report: id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: id, piece, whole,
    turns array<struct<role, text>>; the pieces of a conversation in order make it up.

    Rows stand by turn, nulls first, and rows of one turn by the MD5 of role and text. A row is
    blank, or else a duplicate (role and text stood earlier), or else truncated (does not end in
    a full stop, exclamation or question mark). Edits keep a row (0), give it the role user or
    assistant (1), delete it (2; blank rows and duplicates have to go) or insert an empty turn
    (5); truncated rows that stay add 5. The cheapest edits after which initials of roles read
    `(s?(ua)+)?` are found by bidirectional Dijkstra, of equal cost the ASCII-least string.

    Equal rows become one with a number before they are sorted. Sorted ranges of rows are read
    as a stream and cut into stretches. Conversations of more than one stretch, or at the edge
    of a range, are joined by the matrices of their stretches, a few at a time, so no task holds
    a conversation's texts, however many rows it has. Only its edits, which are one value of the
    result, come together.

    Null roles and texts are one blank; null ids are one conversation; null turns stand first
    and count for no gap; other columns are left out; an empty table gives empty results.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    mark = F.md5(F.concat_ws("\u0001", F.coalesce(F.col("id").cast("string"), F.lit("\u0002")), F.length("role"), "role", "text"))
    src = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), _or_blank(role_col).alias("role"), _or_blank(text_col).alias("text")).withColumn("mark", mark)
    one = src.groupBy("id", "turn", "role", "text", "mark").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    again = src.groupBy("mark").agg(F.min(place).alias("early"), F.max(place).alias("late")).filter("early <> late").select("mark", "early")
    seen = F.coalesce(place > F.col("early"), F.lit(False))
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("mark")]
    ordered = one.join(again, "mark", "left").withColumn("seen", seen).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"id {kind}, piece long, whole boolean, {SUMS}, cost long, audit string, edges {EDGES}, turns {TURNS}"
    cut = stored(_mapped(ordered.select("id", "turn", "role", "text", "times", "seen"), _stretches, schema))

    level_schema = f"id {kind}, place long, {SUMS}, edges {EDGES}"
    names = [part.split()[0] for part in SUMS.split(", ")]
    parts = cut.filter("NOT whole")
    # The places of all stretches: the first level, and the rows to which the edits go back.
    level = parts.select("id", F.expr("row_number() OVER (PARTITION BY id ORDER BY piece) - 1L").alias("place"), *names, "edges")
    while True:
        grouped = level.groupBy("id", F.expr(f"place div {FAN_IN}").alias("place")).agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), *names, "edges"))).alias("parts"))

        def join(batches):
            for batch in batches:
                for key, place, members in zip(*(column.to_pylist() for column in batch.columns)):
                    whole = _joined(members)
                    whole.pop("at")
                    yield {"id": key, "place": place, **whole}

        level = stored(_mapped(grouped, join, level_schema))
        if level.filter("place > 0").isEmpty():
            break

    def chosen(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cost, letters = min((e["cost"], e["letters"]) for e in row["edges"] if e["a"] == 0 and e["b"] in LEGAL_ENDS)
                yield {**{name: row[name] for name in ["id", *names]}, "cost": cost, "audit": letters}

    faults = f"id {kind}, {SUMS}, cost long, audit string"
    long_ones = stored(_mapped(level.select("id", *names, "edges"), chosen, faults))
    report = cut.filter("whole").select("id", *names, "cost", "audit").unionByName(long_ones)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    report = report.select(F.col("id").alias(id_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # The letters of each stretch: its rows take as many as they are; insertions at a border go to the later one.
    pieces = parts.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("piece", "rows"))).alias("pieces"))
    spread = long_ones.select("id", "audit").join(pieces, F.col("id").eqNullSafe(F.col("_id"))).select("id", "audit", "pieces.piece", "pieces.rows")

    def dealt(batches):
        for batch in batches:
            for key, audit, piece, sizes in zip(*(column.to_pylist() for column in batch.columns)):
                letters = np.frombuffer(audit.encode(), "S1")
                taken = np.flatnonzero(letters != b"I") + 1
                ends = np.append(np.concatenate(([0], taken))[np.cumsum(sizes)[:-1]], len(letters))
                written = np.concatenate(([0], np.cumsum(letters != b"D")))
                odd = written[-1] % 2
                begin = 0
                for number, end in zip(piece, ends.tolist()):
                    # A legal conversation of an odd number of turns begins with a system turn.
                    done = int(written[begin])
                    state = 0 if done == 0 else 1 if odd and done == 1 else 2 if (done - odd) % 2 else 3
                    yield {"piece": number, "state": state, "letters": audit[begin:end]}
                    begin = end

    edits = _mapped(spread, dealt, "piece long, state int, letters string")

    def applied(batches):
        for batch in batches:
            for key, piece, rows, state, letters in zip(*(column.to_pylist() for column in batch.columns)):
                made = write(letters, state, [(t["role"], t["text"], t["times"]) for t in rows])
                yield {"id": key, "piece": piece, "whole": False, "turns": [{"role": role, "text": text} for role, text in made]}

    out = f"id {kind}, piece long, whole boolean, turns array<struct<role:string,text:string>>"
    mended = _mapped(parts.select("id", "piece", "turns").join(edits, "piece").select("id", "piece", "turns", "state", "letters"), applied, out)
    plain = cut.filter("whole").select("id", "piece", "whole", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return report, plain.unionByName(mended).withColumnRenamed("id", id_col)


def transcript_digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256): SHA-256 of the `role:text` lines of each conversation, joined by line feeds.

    Conversations of one piece are hashed where they stand. The pieces of longer ones are
    sorted and streamed through one hash each, so a task holds one piece at a time.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    lines = turns.select(F.col(id_col).alias("id"), "piece", "whole", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("lines"), F.size("turns").alias("n"))
    single = lines.filter("whole").select("id", F.sha2("lines", 256).alias("repaired_sha256"))

    def hashed(batches):
        held, said, digest = None, False, None
        for batch in batches:
            for key, text, n in zip(*(column.to_pylist() for column in batch.columns)):
                if digest is None or key != held:
                    if digest is not None:
                        yield {"id": held, "repaired_sha256": digest.hexdigest()}
                    held, said, digest = key, False, hashlib.sha256()
                if n:
                    digest.update((("\n" if said else "") + text).encode())
                    said = True
        if digest is not None:
            yield {"id": held, "repaired_sha256": digest.hexdigest()}

    longer = lines.filter("NOT whole").repartition("id").sortWithinPartitions("id", "piece").select("id", "lines", "n")
    return single.unionByName(_mapped(longer, hashed, f"id {kind}, repaired_sha256 string")).withColumnRenamed("id", id_col)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report and digest of every original conversation after `damaged`; one without rows left has zeros and an empty string."""
    report, turns = repair_conversations(damaged(conversations))
    digests = transcript_digests(turns).withColumnRenamed("conv_id", "_id")
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    told = report.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(told, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_sql() -> str:
    """The same result over `conversations` in SQL: a recursion over the rows of each conversation with the best edits for each state of the roles."""
    def way(w: str, cost: str, letter: str, line: str = "") -> str:
        return f"CASE WHEN {w} IS NULL THEN NULL ELSE {{'c': {w}.c + {cost}, 'a': {w}.a || '{letter}', 't': {w}.t{' || ' + line if line else ''}}} END"

    insert = lambda w, role: way(w, "5", "I", f"chr(10) || '{role}:'")
    keep = lambda w: way(w, "more", "K", "chr(10) || role || ':' || text")
    told = lambda w, role: way(w, "(1 + more)", "R", f"chr(10) || '{role}:' || text")
    stays = lambda *ways: "CASE WHEN gone THEN NULL ELSE list_min([" + ", ".join(ways) + "]) END"
    least = lambda *ways: "list_min([" + ", ".join(ways) + "])"
    when = lambda initial, w: f"CASE WHEN role[1:1] = '{initial}' THEN {w} END"
    steps = ", ".join([
        f"{way('w0', '2', 'D')} AS n0", f"{least(way('w1', '2', 'D'), stays(when('s', keep('w0'))))} AS n1",
        f"{least(way('w2', '2', 'D'), stays(*(f(w) for w in ('w0', 'w1', 'w3') for f in (lambda w: when('u', keep(w)), lambda w: told(w, 'user')))))} AS n2",
        f"{least(way('w3', '2', 'D'), stays(when('a', keep('w2')), told('w2', 'assistant')))} AS n3"])
    return "WITH RECURSIVE " + CRC_TABLE + f""",
filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, {crc32_sql('name')} % 20 AS fault FROM filled, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE fault <> 0),
marked AS (SELECT *, md5(coalesce(conv_id::VARCHAR, chr(2)) || chr(1) || length(role) || chr(1) || role || chr(1) || text) AS mark FROM hurt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM marked),
faults AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS short FROM placed),
rows AS MATERIALIZED (SELECT conv_id, turn, place, role, text, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND short AS truncated, blank OR seen AS gone,
 CASE WHEN NOT blank AND NOT seen AND short THEN 5 ELSE 0 END AS more, role[1:1] || lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) AS pair FROM faults),
ways(conv_id, place, w0, w1, w2, w3) AS (
 SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, CASE WHEN false THEN {{'c': 0::BIGINT, 'a': '', 't': ''}} END, {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}},
 {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM (SELECT DISTINCT conv_id FROM rows)
 UNION ALL SELECT conv_id, place, n0, n1, m2, {least('n3', insert('m2', 'assistant'))} FROM (
 SELECT *, {least('n2', insert('n0', 'user'), insert('n1', 'user'), insert('n3', 'user'))} AS m2 FROM (
 SELECT r.conv_id, r.place, {steps} FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1))),
told AS (SELECT conv_id, {least('w0', 'w3')} AS best FROM ways WINDOW last AS (PARTITION BY conv_id ORDER BY place DESC) QUALIFY row_number() OVER last = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""
