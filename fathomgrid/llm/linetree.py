"""Line dedup with a log-template tree, in DataFrame operations only.

Every line with words goes down a tree of fixed depth: by its token count, then by
its ``DEPTH`` leading tokens.  Tokens with a digit are variable fields from the
start.  In a leaf with several lines, a position whose commonest token has less
than half of the lines becomes variable too; if at least ``CONSTANT`` of the
positions stay constant, the lines that agree in these share the leaf's template,
and all other lines are templates of their own.

A template is common if it stands in ``min_docs`` distinct texts or more.  A text of
which common lines hold ``copy`` of the tokens or more looks like a copy of others and
has no vote: so the lines of a document with many near copies are left to the
near-duplicate stage.  Templates with the votes of ``min_docs`` texts recur, and all
their lines are dropped, in copies as well: headers and footers of any number of lines,
lines of one or two tokens too.  Short lines of fields only go by their exact text.
Nothing recurs in fewer than ``min_docs`` documents.

That is ``recurring``, the rule that the SQL at the end states.  ``boilerplate`` is told
which documents are near copies of each other: there every group of near copies has one
vote, a document without copies being a group of its own.

Null texts have no lines.  Lines without words stay.  Equal texts count as one document
and get equal results.  No text is collected; joins on a template are salted by the
document (``SALTS``), as one line may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm.base import settled, stored, unstored

SPACES = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
FIELD = "[^ ]*[0-9][^ ]*"
VARIABLE = "<*>"
DEPTH, CONSTANT, MIN_TOKENS, MIN_DOCS, COPY, SALTS = 3, 0.6, 3, 10, 0.8, 32


def tokens(line: Column) -> Column:
    """Tokens of a line, with those that hold a digit generalised."""
    plain = F.translate(line, SPACES, " " * len(SPACES))
    masked = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, FIELD, VARIABLE)).otherwise(plain)
    return F.array_remove(F.split(masked, " "), "")


def salted(rows: DataFrame, few: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` joined with ``few``, a row for each value of ``on`` at most; rows of one value are dealt by ``salt`` to SALTS tasks."""
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [on, "salt"], how).drop("salt")


def salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")


def templates(docs: DataFrame) -> DataFrame:
    """(x, pos, n, t): token count and template of each line with words of texts (x, salt, text).

    Texts with one x are equal, and told apart by ``salt`` where work is dealt out.
    """
    lines = docs.select("x", "salt", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(WORD))
    lines = lines.withColumn("tokens", tokens(F.col("line")))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf")
    bare = (F.size("tokens") < MIN_TOKENS) & F.forall("tokens", lambda t: t == VARIABLE)
    own = F.when(bare, F.xxhash64(F.trim(F.translate("line", SPACES, " " * len(SPACES))))).otherwise(F.xxhash64("tokens"))
    flat = stored(lines.select("x", "salt", "pos", F.size("tokens").alias("n"), leaf, own.alias("own")))

    # Leaves with several lines, and their templates.
    counts = stored(flat.filter(F.col("n") >= MIN_TOKENS).groupBy("leaf", "own").agg(F.count("*").alias("c"), F.min(F.struct("x", "pos")).alias("at")))
    mixed = settled(counts.groupBy("leaf").agg(F.count("*").alias("k")).filter("k > 1").select("leaf"))
    wanted = counts.join(mixed, "leaf", "left_semi").groupBy("at.x").agg(F.collect_list(F.struct("at.pos", "leaf", "own", "c")).alias("w"))
    wanted = stored(wanted)  # with an exchange of its own on this side, copies of a text can be split in the join
    kinds = docs.select("x", "text").join(wanted.hint("merge"), "x").select(F.split("text", "\n").alias("l"), F.explode("w").alias("w"))
    kinds = kinds.select("w.leaf", "w.own", "w.c", tokens(F.element_at("l", F.col("w.pos") + 1)).alias("tokens"))
    kinds = stored(kinds.dropDuplicates(["leaf", "own"]))  # copies of a text have the line as well
    votes = kinds.select("leaf", "c", F.posexplode("tokens").alias("p", "t")).groupBy("leaf", "p", "t").agg(F.sum("c").alias("c"))
    best = votes.groupBy("leaf", "p").agg(F.max(F.struct("c", "t")).alias("m"), F.sum("c").alias("all"))
    part = best.select("leaf", F.struct("p", F.when(F.col("m.c") * 2 >= F.col("all"), F.col("m.t")).otherwise(VARIABLE).alias("t")).alias("pt"))
    whole = part.groupBy("leaf").agg(F.sort_array(F.collect_list("pt")).alias("pts")).select("leaf", F.col("pts.t").alias("template"))
    constant = F.size(F.filter("template", lambda t: t != VARIABLE))
    whole = settled(whole.filter(constant >= F.size("template") * CONSTANT))
    agree = F.forall(F.zip_with("template", "tokens", lambda a, b: (a == VARIABLE) | (a == b)), lambda x: x)
    general = settled(kinds.join(whole, "leaf").filter(agree).select("own", F.xxhash64(F.lit("template"), "template").alias("general")))
    out = stored(salted(flat.drop("leaf"), general, "own", "left").select("x", "pos", "n", F.coalesce("general", "own").alias("t")).distinct())
    for done in (flat, counts, wanted, kinds):
        unstored(done)
    return out


def voted(at: DataFrame, votes: DataFrame, min_docs: int) -> DataFrame:
    """(x, drop): positions in ``at`` (x, pos, t) of the templates that have ``min_docs`` of the votes (t, a distinct voter)."""
    boiler = votes.groupBy("t").agg(F.count("*").alias("votes")).filter(F.col("votes") >= min_docs).select("t")
    return salted(at.withColumn("salt", salt("x")), settled(boiler), "t", "left_semi").groupBy("x").agg(F.collect_set("pos").alias("drop"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, copy: float = COPY) -> DataFrame:
    """(x, drop) of the texts (x, text) that have lines to drop: the positions of these; ``docs`` as in ``templates``."""
    named = templates(docs)
    common = named.select("t", "x").distinct().groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c") >= min_docs).select("t", F.lit(1).alias("common"))
    marked = salted(named.withColumn("salt", salt("x")), settled(common), "t", "left")
    share = F.sum(F.when(F.col("common") == 1, F.col("n")).otherwise(0)) / F.sum("n")
    mine = F.collect_list(F.when(F.col("common") == 1, F.struct("pos", "t")))
    each = stored(marked.groupBy("x").agg(share.alias("share"), mine.alias("mine")).filter("share > 0"))
    votes = each.filter(F.col("share") < copy).select("x", F.explode(F.array_distinct("mine.t")).alias("t"))
    return voted(each.select("x", F.explode("mine").alias("m")).select("x", "m.pos", "m.t"), votes, min_docs)


def boilerplate(docs: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(x, drop) like ``recurring``; ``groups`` (x, group) has the texts with near copies, or all."""
    named = templates(docs)
    at = named.select("t", "x").distinct()
    votes = at.join(groups.select("x", "group").distinct(), "x", "left").select("t", F.coalesce("group", "x").alias("group")).distinct()
    return voted(named, votes, min_docs)


def left(text: Column, drop: Column) -> Column:
    """``text`` without the lines at positions ``drop``; null ``drop`` leaves it as it is."""
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(drop, i))
    return F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, copy: float = COPY) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of ``docs``; the text of null stays null."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("x"))
    drop = stored(recurring(docs.filter("text is not null").select("x", salt("doc_id"), "text"), min_docs, copy))
    joined = docs.join(drop.hint("merge"), "x", "left")  # the list grows with the documents and is never broadcast
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    gone = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return joined.select("doc_id", count.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), left(F.col("text"), F.col("drop")).alias("kept_text"))


#: The same rows in DuckDB.
SQL = r"""
WITH raw AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
lines AS (SELECT text, pos, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')) AS plain, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS tokens
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
flat AS (SELECT text, pos, len(tokens) AS n, struct_pack(n := len(tokens), l := tokens[1:3]) AS leaf, tokens,
  CASE WHEN len(tokens) < 3 AND len(list_filter(tokens, lambda t: t <> '<*>')) = 0 THEN 'b' || plain ELSE 'o' || array_to_string(tokens, ' ') END AS own FROM lines),
mixed AS (SELECT leaf FROM flat WHERE n >= 3 GROUP BY leaf HAVING count(DISTINCT tokens) > 1),
kinds AS (SELECT leaf, tokens, count(*) AS c FROM flat SEMI JOIN mixed USING (leaf) GROUP BY ALL),
votes AS (SELECT leaf, p, t, sum(c) AS c FROM (SELECT leaf, c, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM kinds) GROUP BY ALL),
best AS (SELECT leaf, p, max(struct_pack(c := c, t := t)) AS m, sum(c) AS total FROM votes GROUP BY ALL),
whole AS (SELECT leaf, list(CASE WHEN m.c * 2 >= total THEN m.t ELSE '<*>' END ORDER BY p) AS template FROM best GROUP BY leaf),
good AS (SELECT * FROM whole WHERE len(list_filter(template, lambda t: t <> '<*>')) >= len(template) * 0.6),
general AS (SELECT kinds.tokens, template FROM kinds JOIN good USING (leaf)
  WHERE len(list_filter(list_zip(template, kinds.tokens), lambda z: z[1] <> '<*>' AND z[1] <> z[2])) = 0),
named AS (SELECT DISTINCT text, pos, n, CASE WHEN g.template IS NULL THEN own ELSE 'g' || array_to_string(g.template, ' ') END AS t
  FROM flat f LEFT JOIN general g ON f.tokens = g.tokens),
common AS (SELECT t FROM named GROUP BY t HAVING count(DISTINCT text) >= 10),
voters AS (SELECT text FROM named LEFT JOIN (SELECT t, 1 AS c FROM common) USING (t) GROUP BY text HAVING sum(CASE WHEN c = 1 THEN n ELSE 0 END) / sum(n) < 0.8),
boiler AS (SELECT t FROM named SEMI JOIN common USING (t) SEMI JOIN voters USING (text) GROUP BY t HAVING count(DISTINCT text) >= 10),
gone AS (SELECT text, list(pos) AS gone FROM named SEMI JOIN boiler USING (t) GROUP BY text)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN coalesce(d.text, '') ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN gone ON gone.text = d.text
"""
