"""Queries: word boxes, tables, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, paragraphs
from ..sources import views as v
from .sql import DOCS, WORDS

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


W = f"w AS ({WORDS})"


@query(f"WITH {W} SELECT page, word_id, conf FROM w WHERE conf > 30 AND trim(text) <> ''")
def confident_words(spark: SparkSession, d: str) -> DataFrame:
    return layout.confident(v.words(spark, d)).select("page", "word_id", "conf")


@query(f"WITH {W}, s AS (SELECT page, word_id, top, top - lag(top) OVER x AS step FROM w WINDOW x AS (PARTITION BY page ORDER BY top, word_id)) SELECT page, word_id, CAST(sum(CASE WHEN step > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, word_id ROWS UNBOUNDED PRECEDING) AS INT) + 1 AS line_no FROM s")
def word_lines_chained(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines_chained(v.words(spark, d)).select("page", "word_id", "line_no")


@query(f"""
    WITH RECURSIVE {W},
    o AS (SELECT page, word_id, top, row_number() OVER (PARTITION BY page ORDER BY top, x0, word_id) AS i FROM w),
    r AS (SELECT page, word_id, i, top AS y, 1 AS n FROM o WHERE i = 1
          UNION ALL SELECT o.page, o.word_id, o.i, CASE WHEN abs(o.top - r.y) > 5 THEN o.top ELSE r.y END, r.n + CASE WHEN abs(o.top - r.y) > 5 THEN 1 ELSE 0 END
          FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1)
    SELECT page, word_id, CAST(n AS INT) AS line_no FROM r
""")
def word_lines_anchored(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines_anchored(v.page_words(spark, d, "x0", "word_id", "top"))


@query(f"""
    WITH RECURSIVE {W},
    o AS (SELECT page, x0, row_number() OVER (PARTITION BY page ORDER BY x0) AS i FROM (SELECT DISTINCT page, x0 FROM w)),
    r AS (SELECT page, i, x0 AS first_x, 0 AS bin, true AS new FROM o WHERE i = 1
          UNION ALL SELECT o.page, o.i, CASE WHEN o.x0 - r.first_x > 20 THEN o.x0 ELSE r.first_x END, r.bin + CASE WHEN o.x0 - r.first_x > 20 THEN 1 ELSE 0 END, o.x0 - r.first_x > 20
          FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1)
    SELECT page, CAST(bin AS INT) AS bin, first_x FROM r WHERE new
""")
def column_bins(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_bins(v.words(spark, d))


@query(f"WITH {W} SELECT page, line, word_id, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_id) AS gap FROM w")
def word_gaps(spark: SparkSession, d: str) -> DataFrame:
    return layout.gaps(v.words(spark, d))


CLUSTERS = """c AS (SELECT page, x0, count(*) AS votes FROM w GROUP BY page, x0),
    s AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) AS step FROM c),
    n AS (SELECT *, CAST(sum(CASE WHEN step > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS INT) AS cluster FROM s),
    k AS (SELECT page, cluster, CAST(sum(votes) AS BIGINT) AS votes, sum(x0 * votes) / sum(votes) AS centre FROM n GROUP BY page, cluster HAVING sum(votes) >= 3)"""


@query(f"WITH {W}, {CLUSTERS} SELECT page, cluster, votes, centre FROM k")
def x_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.clusters(v.words(spark, d))


LINES = """g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_id) AS gap FROM w),
    l AS (SELECT page, line, count(*) AS words, coalesce(max(gap), 0) AS widest, count(*) FILTER (gap > 30) AS wide, max(size) AS size, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
                 CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digits, string_agg(text, ' ' ORDER BY x0, word_id) AS text FROM g GROUP BY page, line),
    c AS (SELECT page, line, words, widest, digits, chars, CASE WHEN wide >= 2 OR (words >= 4 AND digits / chars > 0.3) THEN 'table'
                 WHEN length(text) < 100 AND words < 15 AND (size > 12 OR (text = upper(text) AND text <> lower(text))) THEN 'title' ELSE 'text' END AS class, text FROM l)"""


@query(f"WITH {W}, {LINES} SELECT page, line, words, widest, digits, chars, class FROM c")
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_classes(v.words(spark, d)).drop("text")


BLOCKS = """b AS (SELECT *, lag(class) OVER (PARTITION BY page ORDER BY line) AS before FROM c),
    n AS (SELECT *, CAST(sum(CASE WHEN class <> before THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS INT) AS block_no FROM b),
    k AS (SELECT page, block_no, min(class) AS class, min(line) AS first_line, max(line) AS last_line FROM n GROUP BY page, block_no)"""


@query(f"WITH {W}, {LINES}, {BLOCKS} SELECT page, block_no, class, first_line, last_line FROM k")
def blocks_runs(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(layout.line_classes(v.words(spark, d)))


@query(f"WITH {W}, {LINES}, {BLOCKS} SELECT page, block_no, class, first_line, last_line FROM k WHERE class = 'text' AND last_line - first_line + 1 >= 3")
def long_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The run-length test of table blocks, on the class that the words at hand have."""
    found = layout.line_classes(v.words(spark, d))
    swapped = found.withColumn("class", F.when(F.col("class") == "text", "table").when(F.col("class") == "table", "text").otherwise(F.col("class")))
    return layout.table_blocks(swapped).withColumn("class", F.lit("text"))


NEAR = """p AS (SELECT w.page, w.line, w.word_id, w.text, w.x0, abs(k.centre - w.x0) AS d, row_number() OVER (PARTITION BY k.page, w.word_id ORDER BY abs(k.centre - w.x0), k.centre) AS r,
                 dense_rank() OVER (PARTITION BY k.page, w.word_id ORDER BY k.centre) - 1 AS i FROM w JOIN k ON w.page = k.page),
    a AS (SELECT page, line, word_id, text, x0, CAST(i AS INT) AS "column" FROM p WHERE r = 1)"""


@query(f'WITH {W}, {CLUSTERS}, {NEAR} SELECT page, word_id, "column" FROM a')
def nearest_column_cells(spark: SparkSession, d: str) -> DataFrame:
    return layout.nearest_cells(v.page_words(spark, d, "x0", "word_id"))


@query(f"WITH {W}, {CLUSTERS}, {NEAR} SELECT page, line, \"column\", string_agg(text, ' ' ORDER BY x0, word_id) AS cell FROM a GROUP BY ALL")
def table_grid(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_grid(v.page_words(spark, d, "line", "x0", "word_id", "text"))


@query(f"WITH {W}, b AS (SELECT page, k AS box_id, k * 100 AS bx0, k * 100 + 260 AS bx1, k * 24 AS btop, k * 24 + 60 AS bbottom FROM (SELECT DISTINCT page FROM w), unnest([0, 1, 2]) t(k)) SELECT w.page, word_id, box_id FROM w JOIN b ON w.page = b.page AND x0 >= bx0 AND x1 <= bx1 AND top >= btop AND bottom <= bbottom")
def bbox_containment(spark: SparkSession, d: str) -> DataFrame:
    boxes = v.sheets(spark, d).select("page", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("box_id"))
    k = F.col("box_id")
    boxes = boxes.select("page", "box_id", (k * 100).alias("bx0"), (k * 100 + 260).alias("bx1"), (k * 24).alias("btop"), (k * 24 + 60).alias("bbottom"))
    return layout.inside(v.words(spark, d), boxes).select("page", "word_id", "box_id")


@query(f"""WITH {W}, e AS (SELECT page, max(x1) AS width FROM w GROUP BY page HAVING count(*) >= 20), s AS (SELECT page, x0, x0 / width AS share FROM w JOIN e USING (page)),
    r AS (SELECT page, count(*) FILTER (share < 0.4) AS "left", count(*) FILTER (share > 0.6) AS "right", count(*) FILTER (share BETWEEN 0.4 AND 0.6) AS centre, round(avg(x0) FILTER (share BETWEEN 0.4 AND 0.6), 6) AS split, count(*) AS n FROM s GROUP BY page)
    SELECT page, "left", "right", centre, split, "left" / n > 0.3 AND "right" / n > 0.3 AS two_columns FROM r""")
def column_balance(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_balance(v.page_words(spark, d, "x0", "x1"))


@query(f"WITH {W}, {CLUSTERS}, m AS (SELECT w.page, word_id, min(abs(centre - x0)) AS d FROM w JOIN k ON w.page = k.page GROUP BY w.page, word_id) SELECT page, round(avg(CASE WHEN d < 25 THEN 1.0 ELSE 0.0 END), 6) AS score FROM m GROUP BY page")
def alignment_score(spark: SparkSession, d: str) -> DataFrame:
    words = v.words(spark, d)
    return layout.alignment(words, layout.clusters(words))


@query(f"WITH {W}, g AS (SELECT page, line, word_id, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_id) AS gap FROM w) SELECT page, line, max(gap) AS gap, first(word_id ORDER BY gap DESC, word_id) AS split_before FROM g WHERE gap > 50 GROUP BY page, line")
def widest_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.widest_gap(v.words(spark, d))


@query(f"""WITH {W}, j AS (SELECT DISTINCT page, x0 + line % 2 AS x FROM w WHERE x0 + line % 2 > 0), g AS (SELECT page, x, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS gap FROM j),
    s AS (SELECT page, max(x) - min(x) < 540 AND count(*) > 10 AND coalesce(max(gap), 0) > 135 AS two FROM g GROUP BY page)
    SELECT p.page, CAST(CASE WHEN two THEN 2 ELSE 1 END AS INT) AS column_count FROM (SELECT DISTINCT page FROM w) p LEFT JOIN s ON s.page = p.page""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every second line is set in by one, so that words begin at more places."""
    return layout.page_columns(v.words(spark, d).withColumn("x0", F.col("x0") + F.col("line") % 2), 900)


@query(f"""WITH {W}, j AS (SELECT page, line, word_id, x0 + line * 13 % 50 AS x FROM w), o AS (SELECT page, line, dense_rank() OVER (PARTITION BY page ORDER BY line) AS n, x FROM j),
    a AS (SELECT a.page, a.line, bool_or(abs(a.x - b.x) < 20) AS by_any, bool_or(abs(a.x - b.x) < 20 AND a.x = (SELECT min(c.x) FROM o c WHERE c.page = a.page AND c.n = a.n)) AS by_first
          FROM o a JOIN o b ON a.page = b.page AND b.n = a.n + 1 GROUP BY a.page, a.line),
    f AS (SELECT *, min(CASE WHEN by_any THEN line END) OVER (PARTITION BY page) AS first FROM a)
    SELECT page, count(*) FILTER (line = first OR (by_first AND line > first)) AS aligned, count(*) FILTER (line = first OR (by_first AND line > first)) > 3 AS has_table FROM f GROUP BY page""")
def aligned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines are set in by turns, so that some meet the next one and some do not."""
    return layout.aligned_lines(v.words(spark, d).withColumn("x0", F.col("x0") + F.col("line") * 13 % 50))


@query(f"WITH {W}, {LINES}, e AS (SELECT page, min(x0) AS \"left\", max(x1) AS \"right\", count(DISTINCT line) AS lines FROM w GROUP BY page), f AS (SELECT page, count(*) FILTER (class = 'table') AS table_lines, count(*) FILTER (class = 'title') AS title_lines FROM c GROUP BY page) SELECT page, \"left\", \"right\", lines, table_lines, title_lines, table_lines > 3 AS has_table FROM e JOIN f USING (page)")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    words = v.words(spark, d)
    return layout.page_structure(words, layout.line_classes(words))


@query(f"WITH {W} SELECT page, word_id, CAST(trunc(x0 * 0.25) AS INT) AS x0, CAST(trunc(x1 * 0.25) AS INT) AS x1, CAST(trunc(top * 0.5) AS INT) AS top, CAST(trunc(bottom * 0.5) AS INT) AS bottom FROM w")
def box_scaling(spark: SparkSession, d: str) -> DataFrame:
    return layout.scale_boxes(v.words(spark, d), (2448, 1584), (612, 792))


@query(f"WITH {W}, p AS (SELECT page, CASE WHEN x0 < 320 THEN 'left' ELSE 'right' END AS side, line, string_agg(text, ' ' ORDER BY x0, word_id) AS text FROM w GROUP BY ALL) SELECT * FROM p")
def column_sides(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_sides(v.page_words(spark, d, "line", "x0", "word_id", "text"), 320)


@query(f"""WITH {W}, e AS (SELECT page, max(x1) AS width, count(*) AS words FROM w WHERE line < 20 GROUP BY page),
    l AS (SELECT w.page, line, count(*) AS n, count(*) FILTER (x0 < width / 2) AS lefts FROM w JOIN e ON w.page = e.page WHERE line < 20 GROUP BY w.page, line),
    s AS (SELECT page, CAST(sum(n) AS BIGINT) AS words, sum(lefts) / sum(n) AS left_share, count(*) FILTER (lefts > 0 AND lefts < n) / count(*) AS two_sided FROM l GROUP BY page)
    SELECT page, words, round(left_share, 6) AS left_share, round(two_sided, 6) AS two_sided, words >= 10 AND (left_share BETWEEN 0.3 AND 0.7 OR two_sided > 0.3) AS multicolumn FROM s""")
def multicolumn_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.multicolumn(v.page_words(spark, d, "line", "x0", "x1"))


@query(f"""WITH {W}, {LINES}, a AS (SELECT page, line, list(x0 ORDER BY x0) AS xs, count(*) FILTER (gap > 30) AS wide FROM g GROUP BY page, line),
    n AS (SELECT *, list_concat(coalesce(lag(xs) OVER p, []), coalesce(lead(xs) OVER p, [])) AS near FROM a WINDOW p AS (PARTITION BY page ORDER BY line)),
    r AS (SELECT page, line, wide, len(list_filter(xs, lambda x: len(list_filter(near, lambda y: abs(y - x) <= 5)) > 0)) / len(xs) AS aligned FROM n)
    SELECT r.page, r.line, wide AS wide_gaps, round(aligned, 6) AS aligned, wide >= 2 OR (words >= 4 AND digits / chars > 0.25) OR (words >= 2 AND aligned > 0.6) AS is_table FROM r JOIN c ON r.page = c.page AND r.line = c.line""")
def table_line_scores(spark: SparkSession, d: str) -> DataFrame:
    return layout.table_line_scores(v.words(spark, d))


@query(f"""WITH {W}, g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_id) AS gap FROM w),
    l AS (SELECT page, line, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, avg(gap) AS mean_gap FROM g GROUP BY page, line HAVING count(*) >= 4 AND avg(gap) > 15)
    SELECT page, line, x0, x1, top, bottom, round(mean_gap, 6) AS mean_gap FROM l""")
def table_zones(spark: SparkSession, d: str) -> DataFrame:
    return layout.table_zones(v.words(spark, d))


@query(f"""WITH {W}, z AS (SELECT page, line, x0, word_id, text, max(x1) OVER (PARTITION BY page) AS width FROM w)
    SELECT page, line, CAST(least(1, floor(avg(x0) / (any_value(width) / 2))) AS INT) AS "column", string_agg(text, ' ' ORDER BY x0, word_id) AS text FROM z GROUP BY page, line""")
def line_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_columns(v.page_words(spark, d, "line", "x0", "word_id", "text", "x1"))


@query(f"""WITH {W}, h AS (SELECT DISTINCT page, left(text, 3) AS cell FROM w WHERE line = 0)
    SELECT h.page, cell, min(word_id) AS word_id FROM h JOIN w ON w.page = h.page AND contains(w.text, cell) GROUP BY h.page, cell""")
def cell_anchors(spark: SparkSession, d: str) -> DataFrame:
    words = v.words(spark, d)
    return layout.first_word_with(words.where("line = 0").select("page", F.left("text", F.lit(3)).alias("cell")).distinct(), words)



@query(r"""SELECT l_orderkey, l_linenumber, cell,
    length(regexp_replace(cell, '[^0-9]', '', 'g')) / greatest(length(cell), 1) > 0.5 OR regexp_matches(cell, '^\s*[0-9]|^\s*\([0-9]|^\s*[$€£]\s*[0-9]') AS financial,
    regexp_matches(translate(cell, ',$%()', ''), '^[0-9.-]*[0-9][0-9.-]*$') AS numeric
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '(' || printf('%.2f', l_extendedprice) || ')' WHEN l_returnflag = 'A' THEN '$' || printf('%.2f', l_extendedprice) ELSE 'item ' || l_linenumber END AS cell FROM lineitem)""")
def financial_number_flags(spark: SparkSession, d: str) -> DataFrame:
    amount = F.format_string("%.2f", "l_extendedprice")
    cell = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), amount, F.lit(")"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), amount)).otherwise(F.concat(F.lit("item "), F.col("l_linenumber").cast("string")))
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    return rows.select("*", layout.is_financial(F.col("cell")).alias("financial"), layout.numeric_cell(F.col("cell")).alias("numeric"))


@query("""WITH r AS (SELECT l_suppkey % 25 AS document, l_orderkey AS table_id, l_linenumber AS row, 3 + (l_orderkey % 5 = 0 AND l_linenumber = 2)::INT AS width FROM lineitem),
    t AS (SELECT document, count(*) AS tables, count(*) FILTER (widths > 1) AS broken FROM (SELECT document, table_id, count(DISTINCT width) AS widths FROM r GROUP BY ALL) GROUP BY document),
    p AS (SELECT l_suppkey % 25 AS document, count(*) AS paragraphs, count(*) FILTER (l_quantity < 2) AS empty FROM lineitem GROUP BY 1)
    SELECT document, tables, broken, paragraphs, empty, round(greatest(0.0, least(100.0, 100.0 - 5.0 * broken - 0.05 * empty)), 6)::DOUBLE AS score FROM p JOIN t USING (document)""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem")
    document = F.col("l_suppkey") % 25
    width = 3 + F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2), 1).otherwise(0)
    tables = rows.select(document.alias("document"), F.col("l_orderkey").alias("table_id"), width.alias("width"))
    paras = rows.select(document.alias("document"), F.when(F.col("l_quantity") < 2, " ").otherwise("x").alias("text"))
    return layout.quality(tables, paras)


@query("""WITH r AS (SELECT l_orderkey AS table_id, l_linenumber AS row, list_transform(range(0, CAST(1 + l_linenumber % 3 AS BIGINT)), lambda i: 'c' || i) AS cells FROM lineitem),
    m AS (SELECT table_id, max(len(cells)) AS width FROM r GROUP BY table_id)
    SELECT r.table_id, row, array_to_string(cells, '|') || repeat('|', width - len(cells)) AS cells FROM r JOIN m USING (table_id)""")
def ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("l_linenumber") % 3).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("c"), i.cast("string")))
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), cells.alias("cells"))
    return layout.pad_rows(rows).select("table_id", "row", F.array_join("cells", "|").alias("cells"))


@query(f"WITH p AS (SELECT document, CAST(count(*) AS INT) AS pages FROM ({DOCS}) GROUP BY document) SELECT document, CAST(f AS INT) AS first, CAST(least(f + 20, pages) AS INT) AS \"end\" FROM p, unnest(range(0, pages, 20)) t(f)")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    counted = v.document_pages(spark, d).groupBy("document").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    return layout.page_chunks(counted, 20)


QA = "SELECT CAST(conv_id AS VARCHAR) AS document, CAST(turn AS INT) AS idx, CASE WHEN turn % 3 = 0 THEN 'Q: who ' || role || ' A: ' || role WHEN turn % 3 = 1 THEN 'A:  only ' || role ELSE role END AS text FROM conversations"


@query(f"""WITH p AS ({QA}), s AS (SELECT *, regexp_matches(trim(text), '^Q:\\s+.*\\sA:\\s') AS two FROM p),
    r AS (SELECT document, idx, 0 AS part, CASE WHEN two THEN regexp_extract(trim(text), '^(Q:\\s+.*?)\\s+A:\\s', 1) ELSE trim(text) END AS text FROM s
          UNION ALL SELECT document, idx, 1, regexp_extract(trim(text), '^Q:\\s+.*?\\s+(A:\\s.*)$', 1) FROM s WHERE two)
    SELECT document, idx, part, CASE WHEN starts_with(text, 'Q:') THEN 'question' WHEN starts_with(text, 'A:') THEN 'answer' ELSE 'text' END AS kind, text FROM r""")
def qa_split(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.concat(F.lit("Q: who "), "role", F.lit(" A: "), "role")).when(turn % 3 == 1, F.concat(F.lit("A:  only "), "role")).otherwise(F.col("role"))
    return paragraphs.qa_split(v.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document"), turn.cast("int").alias("idx"), text.alias("text")))


@query(r"""WITH p AS (SELECT p_brand AS document, CAST(p_partkey AS INT) AS idx, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '.....' || (p_partkey % 300) END AS text FROM part),
    e AS (SELECT document, idx, trim(regexp_extract(trim(text), '^(.+?)\.{2,}\s*(\d+)$', 1)) AS title, CAST(regexp_extract(trim(text), '^(.+?)\.{2,}\s*(\d+)$', 2) AS INT) AS page FROM p WHERE regexp_matches(trim(text), '^(.+?)\.{2,}\s*(\d+)$'))
    SELECT document, idx, title, page, title || ' ' || repeat('.', greatest(2, 50 - length(title))) || ' ' || page AS line FROM e""")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("....."), (F.col("p_partkey") % 300).cast("string")))
    return paragraphs.toc_entries(v.table(spark, d, "part").select(F.col("p_brand").alias("document"), F.col("p_partkey").cast("int").alias("idx"), text.alias("text")))


@query(r"""WITH p AS (SELECT page_id, 'see ' || url || ' (or ' || url || ') now' AS text FROM pages),
    s AS (SELECT page_id, string_split_regex(text, 'https?://[^\s)]+') AS t, regexp_extract_all(text, 'https?://[^\s)]+') AS l FROM p),
    r AS (SELECT page_id, k * 2 AS o, t[k] AS text, false AS link FROM s, unnest(range(1, len(t) + 1)) u(k) UNION ALL SELECT page_id, k * 2 + 1, l[k], true FROM s, unnest(range(1, len(l) + 1)) u(k))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS pos, link, text FROM r WHERE text <> ''""")
def hyperlink_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see "), "url", F.lit(" (or "), "url", F.lit(") now"))
    rows = v.table(spark, d, "pages").select("page_id", F.posexplode(paragraphs.link_parts(text)).alias("pos", "x"))
    return rows.select("page_id", "pos", "x.link", "x.text")


@query(f"""WITH p AS (SELECT document, page, regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), '\\n[ \\t]*(?:\\n[ \\t]*)+') AS parts FROM ({DOCS})),
    c AS (SELECT document, page, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\\s*\\n\\s*', ' ', 'g'))), lambda x: x <> '') AS parts FROM p)
    SELECT document, page, CAST(k - 1 AS INT) AS idx, parts[k] AS text FROM c, unnest(range(1, len(parts) + 1)) t(k)""")
def paragraph_scan(spark: SparkSession, d: str) -> DataFrame:
    pages = v.document_pages(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit("\n\n")))
    return paragraphs.paragraphs_of(pages)
