"""Line deduplication by a segment-partition edit join, in DataFrame expressions only.

Lines are compared after trimming. Of equal lines the first occurrence stays, by document id and position. Of two lines
within `threshold` edits the one that occurs first stays; the other goes wherever it stands.

Join: a line is cut to threshold + 1 segments. If a line is within the threshold of a shorter or equally long one, one of the
latter's segments stands in it, near the same place; which places need a look follows from position and length. Keys are
hashes of (length, segment, text). Keys that only one line has are dropped by one narrow aggregation. A key that more
than `CROWDED` lines share is refined: what lies beside the matched segment is segmented again with the edits still allowed
there, so lines that share a long passage meet only where they agree in ever more of the rest. The remaining pairs are
compared exactly: common ends are cut off and a banded bit-parallel edit distance decides on the middle.

Defined cases: lines shorter than `min_chars` after trimming, blank ones too, take no part and stay; null texts and null
ids pass unchanged; a text that had lines and keeps only blank ones is empty; rows that repeat an id and its text are
treated alike; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankfold.llm.common import materialize

THRESHOLD, MIN_CHARS = 1, 16
CROWDED, LEVELS = 64, 12
BROADCAST_ROWS = 1_000_000
_TRIM = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    """Without white space at the ends; the general trim is slow and only asked of lines with more than plain spaces."""
    special = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.when(special, F.btrim(line, F.lit(_TRIM))).otherwise(F.trim(line))


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """`(doc_id, row, pos, line, h, h2)`: lines that take part; `row` tells apart texts of one id."""
    rows = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).filter(F.length("line") >= min_chars)
    return rows.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(20), F.col("line"))})


def _segment(length: Column, edits: int, i: int) -> tuple[Column, Column]:
    """Start and length of segment i of `edits` + 1, the longer ones last."""
    parts = edits + 1
    base, longer = F.floor(length / parts), length % parts
    start = F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - longer))
    return start.cast("int"), (base + (F.lit(i) >= F.lit(parts) - longer).cast("int")).cast("int")


def _places(edits: int, gap: int, i: int) -> range:
    """Shifts at which segment i of a line that is `gap` characters shorter has to be looked for."""
    return range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)


def _key(bucket: Column, edits: int, target: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(bucket, F.lit(edits), target, F.lit(i), piece)


def _entry(text: Column, n: Column, bucket: Column, edits: int, i: int, target: Column, shift: int, probe: bool) -> Column:
    """A key, and what is left beside the match: text, edits allowed there and by how much it is longer than its partner's."""
    start, size = _segment(target, edits, i)
    at = start + shift
    key = _key(bucket, edits, target, i, F.substring(text, at + 1, size))
    right = edits - i >= i  # go on with the side that may hold more edits
    left_over = F.substring(text, at + size + 1, n) if right else F.substring(text, F.lit(1), at)
    gap = (n - at) - (target - start) if right else F.lit(shift)
    fields = [key.alias("key"), F.lit(probe).alias("probe"), left_over.alias("text"), F.lit(edits - i if right else i).alias("edits"),
              gap.cast("int").alias("gap")]
    # A place outside the text has no key, save the empty segment of an empty text.
    return F.when((at >= 0) & (at + size <= n), F.struct(*fields))


def whole_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """Keys of whole lines, `(h, key, probe)`: own segments first, which serve as probe at shift 0 too, then all other places.

    Where segments lie is worked out once, in columns of their own: as parts of the keys these expressions made a method of
    more than 8,000 bytes, which the JVM never compiles.
    """
    text, n, none, bounds, own, probes = F.col("line"), F.col("_n"), F.lit(0).cast("long"), {}, [], []
    for gap in range(threshold + 1):
        for i in range(threshold + 1):
            start, size = F.col(f"_start_{gap}_{i}"), F.col(f"_size_{gap}_{i}")
            bounds[f"_start_{gap}_{i}"], bounds[f"_size_{gap}_{i}"] = _segment(n - gap, threshold, i)
            for shift in _places(threshold, gap, i):
                at = start + shift
                key = F.when((at >= 0) & (at + size <= n), _key(none, threshold, n - gap, i, F.substring(text, at + 1, size)))
                (probes if gap or shift else own).append(key)
    placed = lines.withColumn("_n", F.length("line")).withColumns(bounds)
    keys = placed.select("h", F.posexplode(F.array(*own, *probes)).alias("_place", "key")).filter("key is not null")
    return keys.select("h", "key", (F.col("_place") >= len(own)).alias("probe"))


def first_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """Keys of whole lines, own segments and probes apart, with what is left beside them."""
    text, n, none = F.col("line"), F.col("_n"), F.lit(0).cast("long")
    entries = [_entry(text, n, none, threshold, i, n, 0, False) for i in range(threshold + 1)]
    for gap in range(threshold + 1):
        for i in range(threshold + 1):
            entries += [_entry(text, n, none, threshold, i, n - gap, s, True) for s in _places(threshold, gap, i)]
    return lines.withColumn("_n", F.length("line")).select("h", F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("h", "e.*")


def next_keys(rows: DataFrame, threshold: int) -> DataFrame:
    """Keys of what was left: `rows(h, key, probe, text, edits, gap)`, each refined under its own key."""
    text, n = F.col("text"), F.col("_n")
    entries = []
    for edits in range(threshold + 1):
        for i in range(edits + 1):
            mine = F.col("edits") == edits
            entries.append(F.when(mine & ~F.col("probe"), _entry(text, n, F.col("key"), edits, i, n, 0, False)))
            for gap in range(-edits, edits + 1):
                entries += [F.when(mine & F.col("probe") & (F.col("gap") == gap), _entry(text, n, F.col("key"), edits, i, n - gap, s, True))
                            for s in _places(edits, gap, i)]
    return rows.withColumn("_n", F.length("text")).select("h", F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("h", "e.*")


def _among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a short list is broadcast, a long one joined by a shuffle."""
    short = few.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(few) if short else few, key, "left_semi")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys of at least two lines, of which one is indexed. Copies of a line vanish before the shuffle."""
    return keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("probe").alias("p")).filter(
        "lo <> hi and not p").select("key")


def _pairs(live: DataFrame) -> DataFrame:
    held = live.filter("not probe").select("key", F.col("h").alias("x"))
    met = live.join(held, "key").filter("h <> x").filter("probe or x < h")
    return met.select(F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b")).distinct()


def candidates(lines: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs of line hashes `(a, b)` with a common key that isn't crowded."""
    keys = whole_keys(lines, threshold)
    live = materialize(_among(keys, materialize(_shared(keys)), "key").distinct())
    crowd = materialize(live.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("key"))
    found = _pairs(live.join(crowd, "key", "left_anti"))
    if not crowd.limit(1).count():
        return found
    members = live.join(crowd, "key", "left_semi").select("h").distinct()
    texts = _among(lines.select("h", "line"), materialize(members), "h").distinct()
    rows = materialize(_among(first_keys(texts, threshold), crowd, "key").distinct())
    for level in range(LEVELS):
        rows = materialize(next_keys(rows, threshold).distinct())
        rows = materialize(rows.join(_shared(rows), "key", "left_semi"))
        crowd = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).filter(
            (F.col("n") > CROWDED) & (F.col("most") > 0)).select("key"))
        found = found.union(_pairs(rows.join(crowd, "key", "left_anti").select("key", "h", "probe")))
        rows = rows.join(crowd, "key", "left_semi")
        if not crowd.limit(1).count():
            return found.distinct()
    # So many lines that agree but for a few characters are near each other; all are compared.
    return found.union(_pairs(rows.select("key", "h", "probe"))).distinct()


def within(pairs: DataFrame, a: str, b: str, limit: int) -> DataFrame:
    """Rows whose strings `a` and `b` are at most `limit` edits apart: common ends are cut off, then `banded_distance`.

    The lengths of the common ends and then what lies between are stored before the filter reads them: pushed into the
    filter, their expressions would be worked out at every step.
    """

    def same(p: Column, q: Column) -> Column:
        n = F.col("_shorter")
        at = F.array_position(F.zip_with(F.slice(p, F.lit(1), n), F.slice(q, F.lit(1), n), lambda s, t: s == t), F.lit(False))
        return F.when(at == 0, n).otherwise(at - 1).cast("int")

    def middle(c: str) -> Column:
        return F.slice(c, F.col("_head") + 1, F.size(c) - F.col("_head") - F.col("_tail"))

    first = F.length(a) >= F.length(b)
    cut = pairs.withColumns({"_p": F.split(F.when(first, F.col(a)).otherwise(F.col(b)), ""),
                             "_q": F.split(F.when(first, F.col(b)).otherwise(F.col(a)), "")})
    cut = cut.withColumn("_shorter", F.least(F.size("_p"), F.size("_q"))).filter(F.abs(F.length(a) - F.length(b)) <= limit)
    cut = cut.withColumns({"_head": same(F.col("_p"), F.col("_q")), "_back": same(F.reverse("_p"), F.reverse("_q"))})
    cut = materialize(cut.withColumn("_tail", F.least("_back", F.col("_shorter") - F.col("_head"))))
    cut = materialize(cut.select(*pairs.columns, middle("_p").alias("_p"), middle("_q").alias("_q")))
    near = F.when(F.size("_q") == 0, F.size("_p") <= limit).otherwise(banded_distance(F.col("_p"), F.col("_q"), limit) <= limit)
    return cut.filter(near).select(*pairs.columns)


def banded_distance(pattern: Column, text: Column, limit: int) -> Column:
    """Edit distance of two arrays of characters if at most `limit`, else more than that; the pattern is not shorter.

    The column differences of the 2 * limit + 2 cells around the diagonal are two bit vectors; each character of the text
    moves the band down by one and renews them with a handful of word operations. The distance is followed along the
    band's lower edge until it meets the last row, then along that row.
    """
    width = 2 * limit + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    rows = F.size(pattern)
    start = F.struct(F.lit(((1 << (limit + 1)) - 1) << (width - limit - 1)).alias("up"), F.lit(0).alias("down"),
                     F.lit(limit).alias("score"), F.lit(top >> 1).alias("edge"))

    def step(s: Column, j: Column) -> Column:
        c = F.element_at(text, j + 1)
        match = F.lit(0)
        for k in range(width):
            at = j + (k - limit - 1)
            hit = (at >= 0) & (at < rows) & (F.get(pattern, at) == c)
            match = match + F.when(hit, F.lit(1 << k)).otherwise(F.lit(0))
        return F.struct(s.alias("s"), match.alias("m"), j.alias("j"))

    def advance(v: Column) -> Column:
        s, m = v["s"], v["m"]
        up, down = s["up"], s["down"]
        d = ((m.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(m).bitwiseOR(down).bitwiseAND(F.lit(full))
        w = F.struct(s.alias("s"), v["j"].alias("j"), d.alias("d"), down.bitwiseOR(d.bitwiseOR(up).bitwiseXOR(F.lit(full))).alias("hp"),
                     d.bitwiseAND(up).alias("hn"))
        return w

    def close(w: Column) -> Column:
        s, d, hp, hn = w["s"], w["d"], w["hp"], w["hn"]
        diagonal = w["j"] < rows - limit
        along = (hp.bitwiseAND(s["edge"]) != 0).cast("int") - (hn.bitwiseAND(s["edge"]) != 0).cast("int")
        half = F.shiftright(d, 1)
        return F.struct(
            hn.bitwiseOR(half.bitwiseOR(hp).bitwiseXOR(F.lit(full))).alias("up"), half.bitwiseAND(hp).alias("down"),
            (s["score"] + F.when(diagonal, (d.bitwiseAND(F.lit(top)) == 0).cast("int")).otherwise(along)).alias("score"),
            F.when(diagonal, s["edge"]).otherwise(F.shiftright(s["edge"], 1)).alias("edge"))

    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  names a value for reuse
    return F.aggregate(F.sequence(F.lit(0), F.size(text) - 1), start, lambda s, j: one(one(step(s, j), advance), close), lambda s: s["score"])


def near_links(lines: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different lines within the threshold, as `(a, a2, b, b2)` hashes."""
    pairs = materialize(candidates(lines, threshold))
    ids = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = _among(lines.select("h", "h2", "line"), ids, "h").distinct()
    left, right = (texts.select(F.col("h").alias(c), F.col("h2").alias(f"{c}2"), F.col("line").alias(f"line_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    return within(joined, "line_a", "line_b", threshold).select("a", "a2", "b", "b2")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_column: str = "doc_id",
                text_column: str = "text", short_copies: bool = False) -> DataFrame:
    """All columns of `docs` with the text cut, and `_lines`, `_removed`.

    With `short_copies`, exact copies of lines shorter than `min_chars` go too, save blank ones.
    """
    least = 1 if short_copies else min_chars
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    lines = line_table(narrow, least)
    firsts = materialize(lines.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first")))
    links = near_links(lines.filter(F.length("line") >= min_chars), threshold)
    for c in "ab":
        links = links.join(firsts.select(F.col("h").alias(c), F.col("h2").alias(f"{c}2"), F.col("first").alias(f"first_{c}")), [c, f"{c}2"])
    later = F.col("first_a") > F.col("first_b")
    gone = links.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("h2"))
    kept = firsts.join(gone.distinct(), ["h", "h2"], "left_anti").select("first.*")
    # A text's kept positions, at most as many as it has lines.
    kept = kept.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list("pos").alias("_kept"))
    text = F.col(text_column)
    joined = docs.join(kept, (docs[id_column] == F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left")
    parts = F.split(text, "\n")
    stays = F.filter(parts, lambda x, i: (F.length(_trimmed(x)) < least) | F.array_contains(F.coalesce("_kept", F.array().cast("array<int>")), i))
    active = F.col(id_column).isNotNull() & text.isNotNull()
    result = joined.withColumns({"_lines": F.when(text.isNotNull(), F.size(parts)).otherwise(0), "_stays": stays})
    body = F.when(F.exists("_stays", lambda x: _trimmed(x) != ""), F.array_join("_stays", "\n")).when(
        F.size("_stays") == F.col("_lines"), text).otherwise(F.lit(""))
    removed = F.when(active, F.col("_lines") - F.size("_stays")).otherwise(0)
    return result.withColumns({text_column: F.when(active, body).otherwise(text), "_removed": removed}).select(*docs.columns, "_lines", "_removed")


def report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """`(doc_id, n_lines, n_removed, text)` of every row."""
    return dedup_lines(docs.select("doc_id", "text"), threshold, min_chars).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


SQL = f"""
WITH parts AS (
  SELECT doc_id, CAST(i AS INTEGER) AS pos, string_split(text, chr(10))[i] AS raw
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE text IS NOT NULL),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM parts),
firsts AS (SELECT line, min(row(doc_id, pos)) AS first FROM trimmed WHERE len(line) >= {MIN_CHARS} GROUP BY line),
sized AS (SELECT *, len(line) AS n FROM firsts),
-- One edit leaves the first or the last half as it is; the distance decides.
halves AS (
  SELECT line, n, first, n AS m FROM sized UNION ALL SELECT line, n, first, n - 1 FROM sized),
pairs AS (
  SELECT a.line AS x, a.first AS fx, b.line AS y, b.first AS fy FROM sized a JOIN halves b
    ON a.n = b.m AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.line <> b.line
  UNION SELECT a.line, a.first, b.line, b.first FROM sized a JOIN halves b
    ON a.n = b.m AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.line <> b.line),
near AS (SELECT * FROM pairs WHERE levenshtein(x, y) <= {THRESHOLD}),
gone AS (SELECT CASE WHEN fx > fy THEN x ELSE y END AS line FROM near),
kept AS (SELECT first FROM firsts WHERE line NOT IN (SELECT line FROM gone)),
marked AS (
  SELECT t.doc_id, t.pos, t.raw, t.line, len(t.line) < {MIN_CHARS} OR k.first IS NOT NULL AS stays
  FROM trimmed t LEFT JOIN kept k ON k.first = row(t.doc_id, t.pos)),
made AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (NOT stays) AS INTEGER) AS n_removed,
         CASE WHEN coalesce(bool_or(line <> '') FILTER (stays), false) OR count(*) FILTER (NOT stays) = 0
              THEN string_agg(raw, chr(10) ORDER BY pos) FILTER (stays) ELSE '' END AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text
FROM documents d LEFT JOIN made m USING (doc_id)
"""
