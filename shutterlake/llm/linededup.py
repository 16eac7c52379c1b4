"""Line dedup by a log-template tree, in DataFrame functions alone.

A line is parsed to a leaf of a tree of fixed depth: first the number of its
tokens, then its leading tokens; a token with a digit counts as a field. In a
leaf, a token stays if it stands at its position in two documents or more, and
becomes a field otherwise. If enough of a line's tokens stay, what results is
its template. As a field of few values has each of them in two documents as
soon as there are documents enough, a line has a second template, in which a
token stays only if more than `min_share` of the texts of its leaf have it at
its position, too. A line recurs if either template occurs in `min_docs`
documents or more: it is kept in the first document (of least doc_id) of the
template, and dropped in all others.

A line without a template is its own (with fields for numbers). So is a line of
fewer than `min_tokens` tokens, and one of too many fields, of which a mask
would join unlike lines: these recur where the whole line is equal, numbers
included.

Work follows recurrence: texts are taken apart once, lines and leaves are
counted by their hashes with map-side combine, and only lines of leaves that
hold more than one text and document are moved and split into tokens. Tokens,
lines and templates are compared by 64-bit hashes.

Cases: null text stays null; text of nothing but dropped lines becomes empty.
Empty lines and those of white space alone stay.
Rows of one doc_id are one document, whose repeated lines do not recur; null
doc_ids are one document, the first. Repeated rows fare alike. Extra columns
pass through, whatever their names but those starting with `_ld_`. Lines end
at \\n, other white space parts tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.prefilter import may_match
from shutterlake.session import discard, spool

DEPTH, MIN_DOCS, MIN_TOKENS, KEEP_SHARE, MIN_SHARE = 3, 2, 4, 0.7, 0.5
FIELD = "<*>"
_WHITE = r"[\x20\x09-\x0D]"
_NO_ID = -(1 << 63)


def is_tidy(text: Column) -> Column:
    """Whether no line of a text, or a line, needs tidying: cheap tests."""
    clean = ~text.startswith(" ") & ~text.endswith(" ")
    for x in ("  ", " \n", "\n "):
        clean = clean & ~text.contains(x)
    return clean & ~text.rlike(r"[0-9\t\x0b\x0c\r]")


def single(line: Column) -> Column:
    """The line's tokens with one blank between them."""
    return F.regexp_replace(F.regexp_replace(line, rf"^{_WHITE}+|{_WHITE}+$", ""), rf"{_WHITE}+", " ")


def masked(line: Column, min_tokens: int, keep_share: float) -> Column:
    """The single-blank line, its tokens with a digit as fields; a line of fewer than min_tokens as it is, and with \\n before it one whose share of other tokens is below keep_share."""
    fields = F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)
    n = F.size(F.split(line, " "))
    few = n - F.regexp_count(fields, F.lit(r"(?<![^ ])<\*>(?![^ ])")) < F.lit(keep_share) * n
    fields = F.when(few, F.concat(F.lit("\n"), line)).otherwise(fields)
    return F.when(F.substring_index(line, " ", min_tokens - 1) == line, line).otherwise(fields) if min_tokens > 1 else fields


def tidy_lines(text: Column, min_tokens: int, keep_share: float) -> Column:
    """All tidy lines of a text, as an array: made below the explosion, where text is read once and not once a line."""
    raw = F.split(text, "\n")
    return F.when(is_tidy(text), raw).otherwise(F.transform(raw, lambda x: F.when(is_tidy(x), x).otherwise(masked(single(x), min_tokens, keep_share))))


def lines_of(docs: DataFrame, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, keep_share: float = KEEP_SHARE) -> DataFrame:
    """_ld_id, _ld_row (hash of the text), _ld_no (line, from 0), _ld_line (tidy), _ld_leaf (null if only the whole line counts) and _ld_hash of every line that has a token."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_ld_id"), F.xxhash64("text").alias("_ld_row"), tidy_lines(F.col("text"), min_tokens, keep_share).alias("_ld_lines"))
    d = d.select("_ld_id", "_ld_row", F.posexplode_outer("_ld_lines").alias("_ld_no", "_ld_line")).where(F.col("_ld_line") != "")  # a plain explosion adds filters that make the lines anew
    tokens = F.octet_length("_ld_line") - F.octet_length(F.replace("_ld_line", F.lit(" "), F.lit(""))) + 1
    leaf = F.when((F.col("_ld_n") >= min_tokens) & ~F.col("_ld_line").startswith("\n"), F.xxhash64("_ld_n", F.substring_index("_ld_line", " ", depth)))
    return d.withColumn("_ld_n", tokens).select("_ld_id", "_ld_row", "_ld_no", "_ld_line", leaf.alias("_ld_leaf"), F.xxhash64("_ld_line").alias("_ld_hash"))


def templates(lines: DataFrame, keep_share: float, min_share: float) -> DataFrame:
    """_ld_hash, the array _ld_templates, and the least and greatest document lo and hi of the lines whose template is not the line itself.

    Joins are left to adaptive execution, which splits hot leaves and cells: a
    side of one row a key is spooled first, so that both sides are plain shuffles.
    """
    in_leaf = lines.where("_ld_leaf is not null")
    leaves = in_leaf.groupBy("_ld_leaf").agg(F.min("_ld_hash").alias("a"), F.max("_ld_hash").alias("b"), F.min("_ld_id").alias("lo"), F.max("_ld_id").alias("hi"))
    leaves = spool(leaves.where("a <> b and lo <> hi").select("_ld_leaf"))
    # one row a text; the filter lets all of a leaf pass or nothing, and a leaf of one text gives it no template but itself
    texts = may_match(in_leaf, leaves, "_ld_leaf").groupBy("_ld_leaf", "_ld_hash").agg(F.first("_ld_line").alias("line"), F.min("_ld_id").alias("lo"), F.max("_ld_id").alias("hi"))
    texts = texts.withColumn("tokens", F.split("line", " ")).drop("line")
    texts = spool(texts.withColumn("n", F.size("tokens")))
    sizes = spool(texts.groupBy("_ld_leaf").agg(F.count("*").alias("texts")))
    each = texts.join(sizes, "_ld_leaf").select("_ld_hash", "_ld_leaf", "lo", "hi", "texts", "n", F.posexplode_outer("tokens").alias("at", "token")).where(F.col("token") != FIELD)
    each = each.withColumn("cell", F.xxhash64("_ld_leaf", "at", "token"))
    share = F.col("n_texts") > F.lit(min_share) * F.col("texts")
    cells = each.groupBy("cell").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("*").alias("n_texts"), F.first("texts").alias("texts")).where("a <> b").select("cell", share.alias("common"))
    cells = spool(cells)
    common = F.when(F.col("common"), F.col("cell"))
    built = each.select("_ld_hash", "n", "cell").join(cells, "cell").groupBy("_ld_hash", "n").agg(F.bit_xor("cell").alias("stays"), F.count("*").alias("n_stays"), F.bit_xor(common).alias("common"), F.count(common).alias("n_common"))

    def template(fixed: str) -> Column:
        return F.when(F.col(f"n_{fixed}") >= F.lit(keep_share) * F.col("n"), F.xxhash64(fixed, F.lit("template")))

    made = F.array_distinct(F.array_compact(F.array(template("stays"), template("common"))))
    built = built.select("_ld_hash", made.alias("_ld_templates")).where(F.size("_ld_templates") > 0)
    out = spool(built.join(texts.select("_ld_hash", "lo", "hi"), "_ld_hash"))
    discard(leaves, texts, sizes, cells)
    return out


def _enough(lines: DataFrame, of: DataFrame, key: str, min_docs: int) -> DataFrame:
    """The keys of (_ld_hash, key) whose lines stand in min_docs documents or more."""
    pairs = may_match(lines, of, "_ld_hash").select("_ld_hash", "_ld_id").distinct().join(of.select("_ld_hash", key).distinct(), "_ld_hash")
    return pairs.select(key, "_ld_id").distinct().groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(key)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, keep_share: float = KEEP_SHARE, min_share: float = MIN_SHARE) -> DataFrame:
    """_ld_id, _ld_row and the array _ld_drop of line numbers to drop, of the texts that lose any."""
    lines = spool(lines_of(docs, min_tokens, depth, keep_share))
    own = templates(lines, keep_share, min_share)
    some = own.select("_ld_hash", F.explode("_ld_templates").alias("_ld_template"), "lo", "hi")
    ends = some.groupBy("_ld_template").agg(F.min("lo").alias("keep"), F.max("hi").alias("last")).where("keep <> last").select("_ld_template", "keep")
    # a line that recurs as it is does so under its template, too
    equal = lines.groupBy("_ld_hash").agg(F.min("_ld_id").alias("keep"), F.max("_ld_id").alias("last")).where("keep <> last").select("_ld_hash", "keep")
    if min_docs > 2:
        ends = ends.join(_enough(lines, some, "_ld_template", min_docs), "_ld_template", "left_semi")
        equal = spool(equal)
        equal = equal.join(_enough(lines, equal.withColumn("_ld_same", F.col("_ld_hash")), "_ld_same", min_docs), F.col("_ld_hash") == F.col("_ld_same"), "left_semi")
    masked_too = some.select("_ld_hash", "_ld_template").join(spool(ends), "_ld_template").select("_ld_hash", "keep")
    recurring = spool(masked_too.union(equal).groupBy("_ld_hash").agg(F.min("keep").alias("keep")))
    lost = may_match(lines.select("_ld_id", "_ld_row", "_ld_no", "_ld_hash"), recurring, "_ld_hash").join(recurring, "_ld_hash").where("_ld_id <> keep")
    lost = spool(lost.groupBy("_ld_id", "_ld_row").agg(F.collect_set("_ld_no").alias("_ld_drop")))
    discard(lines, own, recurring)
    return lost


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, keep_share: float = KEEP_SHARE, counts: bool = False, min_share: float = MIN_SHARE) -> DataFrame:
    """docs without their recurring lines. counts adds n_lines and n_dropped."""
    lost = dropped_lines(docs, min_docs, min_tokens, depth, keep_share, min_share)
    rows = docs.withColumn("_ld_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_ld_own", F.xxhash64("text"))
    joined = rows.join(lost, (rows["_ld_key"] == lost["_ld_id"]) & (rows["_ld_own"] == lost["_ld_row"]), "left")
    # the places that stay, by a hash set: array_contains would be quadratic in the lines of a text
    joined = joined.withColumn("_ld_lines", F.when(F.col("_ld_drop").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_drop"))
    kept = F.transform(stay, lambda i: F.get("_ld_lines", i))
    text = F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if counts:
        out += [(breaks + 1).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)
