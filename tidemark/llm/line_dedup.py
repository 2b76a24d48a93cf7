"""Line dedup within an edit distance, with DataFrame functions only.

A line goes if it repeats an earlier line, or if an earlier line lies within ``tau`` edits (insertions, deletions,
substitutions of characters). Earlier means a smaller (doc_id, position). Lines shorter than ``min_chars``
characters only go as exact repeats if they hold a word (not at all without ``short_repeats``).

1. *Exact repeats* collapse by a grouped minimum: one row per distinct line, with its first place.
2. *Segment index.* A distinct line r is cut into tau + 1 segments. If s lies within tau edits of r, one segment i
   occurs in s unchanged, at a place shifted by at most i - 1 characters from the left and tau + 1 - i from the
   right, and the parts before and after it lie within i - 1 and tau + 1 - i edits. So s probes, for every length
   from its own down to tau less, only those substrings; keys hold segment number, length and a hash.
3. *Residual check in the join.* The longer part beside the matching segment is cut again by the same rule; one
   of its pieces must match too. Families of many variants of one line would otherwise meet in one key.
4. *Verification* by Hyyrö's banded bit-parallel edit distance: the band of 2 tau + 1 diagonals is one bigint, one
   step per character.

Joins carry hashes; texts come back for candidate lines only. The table of repeats and the candidates are broadcast
if their counted rows allow it, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small

TAU = 1
MIN_CHARS = 24
# Candidate lines and flagged places that are broadcast at most, by counted rows.
SMALL_ROWS = 500_000


def _cut(df: DataFrame, parts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add, for every name with (length, k), the offsets ``name_p<i>`` and lengths ``name_w<i>`` of k nearly equal
    segments (i from 0); the last ``length % k`` are one longer. Each step is a projection of its own, so that no
    expression is repeated inside another."""
    df = df.select("*", *[c for name, (length, k) in parts.items() for c in (
        F.call_function("div", length, F.lit(k)).cast("int").alias(f"{name}_b"), (length % k).cast("int").alias(f"{name}_x"))])
    out = []
    for name, (_, k) in parts.items():
        base, extra = F.col(f"{name}_b"), F.col(f"{name}_x")
        for i in range(k):
            out.append((base * i + F.greatest(F.lit(0), extra - (k - i))).alias(f"{name}_p{i}"))
            out.append((base + F.when(extra >= k - i, 1).otherwise(0)).alias(f"{name}_w{i}"))
    return df.select("*", *out)


def _residual(i: int, parts: int) -> tuple[int, bool]:
    """Edits allowed in the longer part beside segment ``i`` (from 1), and whether that part is the left one."""
    left, right = i - 1, parts - i
    return (left, True) if left > right else (right, False)


def _layout(df: DataFrame, tau: int, deltas: range) -> DataFrame:
    """Segments ``s<delta>`` of an indexed line of n - delta characters, and the pieces ``r<delta>_<i>`` of the part
    beside segment i."""
    k = tau + 1
    df = _cut(df, {f"s{d}": (F.col("n") - d, k) for d in deltas})
    rest = {}
    for d in deltas:
        for i in range(1, k + 1):
            budget, left = _residual(i, k)
            at, size = F.col(f"s{d}_p{i - 1}"), F.col(f"s{d}_w{i - 1}")
            rest[f"r{d}_{i}"] = (at if left else F.col("n") - d - at - size, budget + 1)
    return _cut(df, rest)


def _hash(line: Column, offset: Column, size: Column) -> Column:
    return F.xxhash64(F.substring(line, offset + 1, size))


def _short(j: int, h: Column) -> Column:
    return F.shiftright(h, 32).cast("int").bitwiseXOR(F.lit(j))


def index_rows(tau: int) -> Column:
    """Array of (key, rest) for a line as the indexed side, from the columns of ``_layout``."""
    out, line = [], F.col("line")
    for i in range(1, tau + 2):
        budget, left = _residual(i, tau + 1)
        at, size = F.col(f"s0_p{i - 1}"), F.col(f"s0_w{i - 1}")
        start = F.lit(0) if left else at + size
        rest = [_short(j, _hash(line, start + F.col(f"r0_{i}_p{j}"), F.col(f"r0_{i}_w{j}"))) for j in range(budget + 1)]
        out.append(F.struct(F.xxhash64(F.lit(i), F.col("n"), _hash(line, at, size)).alias("key"), F.array(*rest).alias("rest")))
    return F.array(*out)


def probe_rows(tau: int) -> Column:
    """Array of (key, rest) for a line as the probing side: indexed lines are as long or up to tau shorter.

    Entries that would lie outside the line are null.
    """
    out, line, n = [], F.col("line"), F.col("n")
    for delta in range(tau + 1):
        for i in range(1, tau + 2):
            budget, left = _residual(i, tau + 1)
            p, size = F.col(f"s{delta}_p{i - 1}"), F.col(f"s{delta}_w{i - 1}")
            for d in range(-(i - 1), i):
                if abs(d - delta) > tau + 1 - i:
                    continue
                at = p + d
                start, length = (F.lit(0), at) if left else (at + size, n - at - size)
                rest, extra = [], (d if left else delta - d)  # the probing part is longer by ``extra``
                for j in range(budget + 1):
                    q, w = F.col(f"r{delta}_{i}_p{j}"), F.col(f"r{delta}_{i}_w{j}")
                    for e in range(-j, j + 1):
                        if abs(e - extra) <= budget - j:
                            rest.append(F.when((q + e >= 0) & (q + e + w <= length), _short(j, _hash(line, start + q + e, w))))
                row = F.struct(F.xxhash64(F.lit(i), n - delta, _hash(line, at, size)).alias("key"), F.array(*rest).alias("rest"))
                out.append(F.when((n > delta) & (at >= 0) & (at + size <= n), row))
    return F.array(*out)


def within(rc: Column, sc: Column, tau: int) -> Column:
    """Whether the edit distance of two arrays of characters is at most ``tau``, by the banded bit-parallel algorithm.
    They should be stored columns: an expression would be evaluated again at every character.

    Column j of the distance matrix is seen through the rows j - tau .. j + tau (bit 0 is the upper one); VP and VN
    hold the vertical differences +1 and -1 there. The score follows the lowest diagonal of the band until it
    reaches the last row of r, and from there that row to the end of s. Needs more than ``tau`` characters in r.
    """
    width = 2 * tau + 1
    mask = F.lit((1 << width) - 1).cast("bigint")
    m, n = F.size(rc), F.size(sc)

    def state(vp, vn, score):
        return F.struct(vp.cast("bigint").alias("vp"), vn.cast("bigint").alias("vn"), score.cast("int").alias("score"))

    def step(a, j):
        c, pm = F.get(sc, j - 1), F.lit(0).cast("bigint")
        for k in range(width):  # rows above or below r read as null, which equals no character
            row = j + F.lit(k - tau)
            hit = F.coalesce(F.when(row >= 1, F.get(rc, row - 1)) == c, F.lit(False))
            pm = pm + F.when(hit, F.lit(1 << k)).otherwise(F.lit(0))
        vp, vn = a["vp"], a["vn"]

        def d0_of(pm):
            return (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(mask)

        def next_state(d0):
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask)
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            last = m - tau  # columns up to here move the score down the diagonal, later ones along the last row
            at = F.pow(F.lit(2.0), (F.lit(width - 1) - (j - last)).cast("double")).cast("bigint")
            diagonal = F.when(d0.bitwiseAND(F.lit(1 << (width - 1)).cast("bigint")) != 0, 0).otherwise(1)
            along = F.when(hp.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(at) != 0, 1).otherwise(0)
            return state(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask), down.bitwiseAND(hp),
                         a["score"] + F.when(j <= last, diagonal).otherwise(along))

        # lists of one element name a value, so that it is computed once
        return F.get(F.transform(F.transform(F.array(pm), d0_of), next_state), F.lit(0))

    start = state(F.lit(((1 << (tau + 1)) - 1) << tau), F.lit(0), F.lit(tau))
    score = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["score"])
    return (F.abs(m - n) <= tau) & (m > tau) & (score <= tau)


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, th, pos, line, h, h2): every \\n-split line with its document's id and text hash and its own hashes."""
    rows = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def near_line_pairs(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """(r, s): hashes of lines that share a segment and pass the residual check. ``distinct`` holds (h, line)."""
    lines = distinct.select("h", "line", F.length("line").alias("n"))
    index = _layout(lines, tau, range(1)).select(F.col("h").alias("r"), F.explode(index_rows(tau)).alias("e")).select("r", "e.key", F.col("e.rest").alias("rr"))
    probe = (_layout(lines, tau, range(tau + 1)).select(F.col("h").alias("s"), F.explode(probe_rows(tau)).alias("e"))
             .filter(F.col("e").isNotNull()).select("s", F.col("e.key").alias("pk"), F.col("e.rest").alias("pr")))
    on = (F.col("key") == F.col("pk")) & F.arrays_overlap("rr", "pr") & (F.col("r") != F.col("s"))
    return index.join(probe, on).select(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).distinct()


def flag_lines(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS,
               short_repeats: bool = True) -> DataFrame:
    """(k, th, pos, near): every line that goes; ``near`` is true if an earlier line is near it, false for exact repeats."""
    long = F.length("line") >= min_chars
    lines = _lines(df, key, text).filter(long | F.col("line").rlike(r"[^ \t-\r]") if short_repeats else long)
    place = F.struct("k", "pos")
    repeats = (lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
               .select(F.col("h").alias("dh"), F.col("h2").alias("dh2"), "first")).checkpoint()
    n_repeats = repeats.count()
    same = (F.col("h") == F.col("dh")) & (F.col("h2") == F.col("dh2"))
    distinct = (lines.filter(long).join(small(repeats, n_repeats, SMALL_ROWS), same, "left")
                .filter(F.col("first").isNull() | F.col("first").eqNullSafe(place)).select("h", "h2", "k", "pos", "line"))
    pairs = near_line_pairs(distinct, tau).checkpoint()
    wanted = pairs.select(F.explode(F.array("r", "s")).alias("w")).distinct().checkpoint()
    found = distinct.join(small(wanted, wanted.count(), SMALL_ROWS), F.col("h") == F.col("w"), "left_semi")
    found = found.withColumn("chars", F.split("line", "")).drop("line").checkpoint()
    a = found.select(*[F.col(c).alias(f"{c}_a") for c in ("h", "h2", "k", "pos", "chars")])
    b = found.select(*[F.col(c).alias(f"{c}_b") for c in ("h", "h2", "k", "pos", "chars")])
    both = pairs.join(a, F.col("r") == F.col("h_a")).join(b, F.col("s") == F.col("h_b"))
    close = both.filter(within(F.col("chars_a"), F.col("chars_b"), tau))
    before = F.when(F.col("k_a").eqNullSafe(F.col("k_b")), F.col("pos_a") < F.col("pos_b")).when(F.col("k_a").isNull(), True).when(F.col("k_b").isNull(), False).otherwise(F.col("k_a") < F.col("k_b"))
    gone = close.select(F.when(before, F.col("h_b")).otherwise(F.col("h_a")).alias("dh"),
                        F.when(before, F.col("h2_b")).otherwise(F.col("h2_a")).alias("dh2")).distinct()
    flags = (repeats.select("dh", "dh2", "first", F.lit(False).alias("near"))
             .unionByName(gone.select("dh", "dh2", F.lit(None).cast(repeats.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
             .groupBy("dh", "dh2").agg(F.max("first").alias("first"), F.max("near").alias("near"))).checkpoint()
    hit = lines.drop("line").join(small(flags, flags.count(), SMALL_ROWS), same)
    return hit.filter(F.col("near") | ~F.col("first").eqNullSafe(place)).select(
        "k", "th", "pos", (F.col("near") & (F.col("first").isNull() | F.col("first").eqNullSafe(place))).alias("near"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS,
                short_repeats: bool = True) -> DataFrame:
    """Remove the flagged lines from ``text``; add n_lines, n_exact and n_near (lines before, removed as repeat, as near).

    Row count and all other columns stay (columns of the added names are replaced). A null text stays null with 0
    lines, an empty text has one empty line. If all lines go, the text is empty. Of rows that repeat both id and
    text each gets the same result; a null id is earlier than any other.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_exact", "n_near")]
    # the given columns travel as one struct, so that none of their names meets one of the names used here
    rows = df.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    flagged = flag_lines(rows, "_key", "_text", tau, min_chars, short_repeats)
    drop = (flagged.distinct().groupBy("k", "th").agg(F.collect_list("pos").alias("_drop"), F.count(F.when(F.col("near"), 1)).alias("_near"))
            ).checkpoint()
    size = drop.agg(F.sum(F.size("_drop") + 4)).first()[0] or 0
    joined = rows.withColumn("_h", F.xxhash64("_text")).join(
        small(drop, size, 4 * SMALL_ROWS), F.col("_key").eqNullSafe(F.col("k")) & (F.col("_h") == F.col("th")), "left")
    parts = F.split("_text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    cleaned = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(parts))
    near = F.coalesce("_near", F.lit(0))
    return joined.select(*[cleaned.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], n.cast("bigint").alias("n_lines"),
                         (F.coalesce(F.size("_drop"), F.lit(0)) - near).cast("bigint").alias("n_exact"), near.cast("bigint").alias("n_near"))


def op5_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def dedup_sql(docs: str = "documents") -> str:
    """Common table expression ``deduped``: (doc_id, n_lines, n_exact, n_near, new_text), for tau = 1 and unique ids.

    Lines within one edit are found by their one-character deletions, independently of the segment index.
    """
    return f"""ln AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}),
el AS (SELECT *, min((doc_id, pos)) OVER (PARTITION BY line) AS fst FROM ln
 WHERE length(line) >= {MIN_CHARS} OR regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS MATERIALIZED (SELECT doc_id, pos, line, length(line) AS n, row_number() OVER (ORDER BY doc_id, pos) AS id FROM el
 WHERE fst = (doc_id, pos) AND length(line) >= {MIN_CHARS}),
v AS MATERIALIZED (SELECT id, n, k, hash(left(line, k - 1) || substr(line, k + 1)) AS hv FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM u)),
pr AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.hv = b.hv AND a.k = b.k AND a.n = b.n AND a.id < b.id
 UNION SELECT least(a.id, u.id), greatest(a.id, u.id) FROM v a JOIN u ON a.hv = hash(u.line) AND a.n = u.n + 1),
gone AS (SELECT DISTINCT line FROM u WHERE id IN (SELECT y FROM pr)),
fl AS (SELECT el.doc_id, el.pos, el.fst <> (el.doc_id, el.pos) AS ex, gone.line IS NOT NULL AS nr FROM el LEFT JOIN gone USING (line)),
deduped AS (SELECT ln.doc_id, count(*) AS n_lines, count(*) FILTER (ex) AS n_exact, count(*) FILTER (nr AND NOT ex) AS n_near,
 coalesce(string_agg(line, chr(10) ORDER BY ln.pos) FILTER (NOT coalesce(ex OR nr, false)), '') AS new_text
 FROM ln LEFT JOIN fl ON ln.doc_id = fl.doc_id AND ln.pos = fl.pos GROUP BY 1)"""


SQL = f"""WITH {dedup_sql()}
SELECT doc_id, n_lines, n_exact, n_near, length(new_text) AS kept_chars, md5(new_text) AS kept_md5 FROM deduped"""
