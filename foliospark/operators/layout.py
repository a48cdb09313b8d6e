"""Geometry over word boxes ``words(page, word_id, text, x0, x1, top, bottom, size, conf, line)``.

Scans over neighbours are windows partitioned by page (and line), so their state
is bounded by a page, never by the table. What needs no window takes pages
``(page, words)`` with an array of their words and works in the page's row; word boxes
are gathered to such pages first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..sources.views import gathered

LINE_TOLERANCE, CLUSTER_TOLERANCE, CLUSTER_MIN = 10, 30, 3
TABLE_GAP, TABLE_WORDS, DIGIT_SHARE = 30, 4, 0.3
MIN_CONFIDENCE = 30


def _island(changed: Column, w) -> Column:
    """Numbers runs: a new one wherever ``changed`` holds."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def confident(words: DataFrame) -> DataFrame:
    return words.where((F.col("conf") > MIN_CONFIDENCE) & (F.trim("text") != ""))


def lines_chained(words: DataFrame, tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """Lines by vertical steps between neighbours: a step above the tolerance starts one."""
    w = Window.partitionBy("page").orderBy("top", "word_id")
    step = F.col("top") - F.lag("top").over(w)
    numbered = words.withColumn("step", step)
    return numbered.withColumn("line_no", _island(F.coalesce(F.col("step") > tolerance, F.lit(False)), w).cast("int") + 1).drop("step")


def _pages(words: DataFrame) -> DataFrame:
    """``page, words``: word boxes as an array a page. Such pages are taken as they are, in
    order of line, x0 and word_id, so that no word is shuffled or sorted."""
    return words if words.columns == ["page", "words"] else gathered(words)


def _runs(items: Column, new: Callable[[Column, Column], Column]) -> Column:
    """A named array's items in runs; ``new(before, item)`` begins one."""
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | new(F.get(items, i - 1), F.get(items, i)))
    part = lambda s, e: F.transform(F.sequence(s, e - 1), lambda i: F.get(items, i))
    cut = bind(starts, lambda st: F.transform(st, lambda s, k: part(s, F.coalesce(F.get(st, k + 1), n))))
    return F.when(n > 0, cut)


def _by_line(pages: DataFrame, *keep: str) -> DataFrame:
    """Each line's ``words`` in a row of their own, with ``page``, ``line`` and what is kept."""
    lines = _runs(F.col("words"), lambda a, b: ~a["line"].eqNullSafe(b["line"]))
    return pages.select("page", *keep, F.explode(lines).alias("words")).withColumn("line", F.get("words", F.lit(0))["line"])


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def lines_anchored(words: DataFrame, tolerance: int = 5) -> DataFrame:
    """Lines by distance to the first word of the line: an ordered fold a page, which
    gathers where lines begin."""
    fields = ("top", "x0", "word_id")
    pages = _pages(words).select("page", F.sort_array(F.transform("words", lambda w: F.struct(*(w[f].alias(f) for f in fields)))).alias("w"))
    zero = F.struct(F.lit(None).cast("int").alias("y"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        new = a["y"].isNull() | (F.abs(x["top"] - a["y"]) > tolerance)
        return F.when(new, F.struct(x["top"].alias("y"), F.concat(a["starts"], F.array(x["i"])).alias("starts"))).otherwise(a)

    numbered = F.transform("w", lambda x, i: F.struct(x["top"].alias("top"), i.alias("i")))
    begun = pages.select("page", "w", F.aggregate(numbered, zero, step)["starts"].alias("starts"))
    ids = lambda s, e: F.transform(F.sequence(s, e - 1), lambda i: F.get("w", i)["word_id"])
    lines = F.transform("starts", lambda s, k: ids(s, F.coalesce(F.get("starts", k + 1), F.size("w"))))
    return begun.select("page", F.posexplode(lines).alias("k", "ids")).select("page", F.explode("ids").alias("word_id"), (F.col("k") + 1).alias("line_no"))


def column_bins(words: DataFrame, tolerance: int = 20) -> DataFrame:
    """Bins of x0 by distance to the bin's first value: an ordered fold a page."""
    pages = words.groupBy("page").agg(F.array_sort(F.collect_set("x0")).alias("x"))
    zero = F.array().cast("array<int>")

    def step(a: Column, x: Column) -> Column:
        return F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > tolerance), F.concat(a, F.array(x))).otherwise(a)

    return pages.select("page", F.posexplode(F.aggregate("x", zero, step)).alias("bin", "first_x"))


def gaps(words: DataFrame) -> DataFrame:
    """Horizontal gap to the word before, on the same line."""
    w = Window.partitionBy("page", "line").orderBy("x0", "word_id")
    return words.select("page", "line", "word_id", (F.col("x0") - F.lag("x1").over(w)).alias("gap"))


def clusters(words: DataFrame, tolerance: int = CLUSTER_TOLERANCE, least: int = CLUSTER_MIN) -> DataFrame:
    """Clusters of x0 by steps between neighbours; centre and votes of those with enough."""
    counted = words.groupBy("page", "x0").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("page").orderBy("x0")
    stepped = counted.withColumn("step", F.col("x0") - F.lag("x0").over(w))
    numbered = stepped.withColumn("cluster", _island(F.coalesce(F.col("step") > tolerance, F.lit(False)), w).cast("int"))
    out = numbered.groupBy("page", "cluster").agg(F.sum("votes").alias("votes"), (F.sum(F.col("x0") * F.col("votes")) / F.sum("votes")).alias("centre"))
    return out.where(F.col("votes") >= least)


def line_classes(words: DataFrame) -> DataFrame:
    """Each line as table, title or text."""
    w = Window.partitionBy("page", "line").orderBy("x0", "word_id")
    spaced = words.withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    lines = spaced.groupBy("page", "line").agg(
        F.count(F.lit(1)).alias("words"), F.max("gap").alias("widest"), F.count_if(F.col("gap") > TABLE_GAP).alias("wide_gaps"), F.max("size").alias("size"),
        F.sum(F.length("text") + 1).alias("chars"), F.sum(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("digits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    table = (F.col("wide_gaps") >= 2) | ((F.col("words") >= TABLE_WORDS) & (F.col("digits") / F.col("chars") > DIGIT_SHARE))
    title = (F.length("text") < 100) & (F.col("words") < 15) & ((F.col("size") > 12) | ((F.col("text") == F.upper("text")) & (F.col("text") != F.lower("text"))))
    return lines.select("page", "line", "words", F.coalesce("widest", F.lit(0)).alias("widest"), "digits", "chars", F.when(table, "table").when(title, "title").otherwise("text").alias("class"), "text")


def blocks(classes: DataFrame) -> DataFrame:
    """Runs of lines of one class."""
    w = Window.partitionBy("page").orderBy("line")
    before = classes.withColumn("before", F.lag("class").over(w))
    numbered = before.withColumn("block_no", _island(F.coalesce(F.col("class") != F.col("before"), F.lit(False)), w).cast("int"))
    return numbered.groupBy("page", "block_no").agg(F.min("class").alias("class"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def table_blocks(classes: DataFrame, least: int = 3) -> DataFrame:
    found = blocks(classes)
    return found.where((F.col("class") == "table") & (F.col("last_line") - F.col("first_line") + 1 >= least))


def nearest_column(words: DataFrame, centres: DataFrame) -> DataFrame:
    """Each word with the column whose centre is nearest, the left one on ties.

    The few centres of a page are gathered into an array and met by an equality
    join on the page."""
    per_page = centres.groupBy("page").agg(F.array_sort(F.collect_list("centre")).alias("centres"))
    return words.join(per_page, "page").withColumn("column", _nearest(F.col("x0"), F.col("centres"))).drop("centres")


def _nearest(x0: Column, centres: Column) -> Column:
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - x0).alias("d"), i.alias("i"))))["i"].cast("int")


def _centres(words: Column, tolerance: int = CLUSTER_TOLERANCE, least: int = CLUSTER_MIN) -> Column:
    """The centres of a page's :func:`clusters`. All steps are bound, so that no lambda
    evaluates one again for each word."""
    kind = "array<struct<votes:bigint,total:bigint>>"
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("votes"), F.lit(0).cast("long").alias("total"), F.array().cast(kind).alias("done"))
    closed = lambda a: F.concat(a["done"], F.array(F.struct(a["votes"].alias("votes"), a["total"].alias("total"))))

    def step(a: Column, v: Column) -> Column:
        x, votes = v["x0"], v["votes"]
        new = F.coalesce(x - a["last"] > tolerance, F.lit(False))
        fresh = F.struct(x.alias("last"), votes.alias("votes"), (x * votes).alias("total"), closed(a).alias("done"))
        more = F.struct(x.alias("last"), (a["votes"] + votes).alias("votes"), (a["total"] + x * votes).alias("total"), a["done"].alias("done"))
        return F.when(new, fresh).otherwise(more)

    # In the sorted places, a place's votes are the way to where the next one begins.
    def counted(xs: Column, places: Column, begins: Column) -> Column:
        return F.transform(places, lambda x, k: F.struct(x.alias("x0"), (F.coalesce(F.get(begins, k + 1), F.size(xs) + 1) - F.get(begins, k)).alias("votes")))

    xs = F.sort_array(F.filter(F.transform(words, lambda w: w["x0"]), lambda x: x.isNotNull()))
    votes = bind(xs, lambda xs: bind(F.array_distinct(xs), lambda ps: bind(F.transform(ps, lambda x: F.array_position(xs, x)), lambda begins: counted(xs, ps, begins))))
    return F.transform(F.filter(F.aggregate(votes, zero, step, closed), lambda c: c["votes"] >= least), lambda c: c["total"] / c["votes"])


def _placed(words: Column, *keep: str) -> Column:
    """The words of a page with the nearest ``column``, which is found once for each place;
    null for a page without columns."""

    def put(centres: Column) -> Column:
        own = lambda w, places, columns: F.struct(*(w[f].alias(f) for f in keep), F.get(columns, F.array_position(places, w["x0"]).cast("int") - 1).alias("column"))
        given = lambda places: bind(F.transform(places, lambda x: _nearest(x, centres)), lambda columns: F.transform(words, lambda w: own(w, places, columns)))
        return F.when(F.size(centres) > 0, bind(F.array_distinct(F.transform(words, lambda w: w["x0"])), given))

    return bind(_centres(words), put)


def nearest_cells(words: DataFrame) -> DataFrame:
    """Each word with the nearest of its page's columns, in the page's row."""
    return _pages(words).select("page", F.explode(bind(F.col("words"), lambda ws: _placed(ws, "word_id"))).alias("w")).select("page", "w.word_id", "w.column")


def page_grid(words: DataFrame) -> DataFrame:
    """The :func:`grid` of each page in its row: along a line, words of one column follow
    each other."""
    pages = _pages(words).select("page", bind(F.col("words"), lambda ws: _placed(ws, "line", "text")).alias("placed"))
    cells = pages.select("page", F.explode(_runs(F.col("placed"), lambda a, b: ~a["line"].eqNullSafe(b["line"]) | (a["column"] != b["column"]))).alias("words"))
    first = F.get("words", F.lit(0))
    return cells.select("page", first["line"].alias("line"), first["column"].alias("column"), _joined(F.col("words")).alias("cell"))


def grid(placed: DataFrame) -> DataFrame:
    """Cells of a table: words of one line and column joined by blanks."""
    words = F.array_sort(F.collect_list(F.struct("x0", "word_id", "text")))
    return placed.groupBy("page", "line", "column").agg(F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("cell"))


def inside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words inside a box ``(page, box_id, bx0, bx1, btop, bbottom)`` of their page."""
    within = (F.col("x0") >= F.col("bx0")) & (F.col("x1") <= F.col("bx1")) & (F.col("top") >= F.col("btop")) & (F.col("bottom") <= F.col("bbottom"))
    return words.join(boxes, "page").where(within)


def column_balance(words: DataFrame) -> DataFrame:
    """Words left of, right of and about the middle of the page; the split between."""
    pages = _pages(words).select("page", F.transform("words", lambda w: w["x0"]).alias("xs"), F.array_max(F.transform("words", lambda w: w["x1"])).alias("width")).where(F.size("xs") >= 20)
    pages = pages.withColumn("shares", bind(F.col("width"), lambda width: F.transform("xs", lambda x: x / width)))
    size = lambda ok: F.size(F.filter("shares", ok)).cast("long")
    out = pages.select(
        "page", size(lambda x: x < 0.4).alias("left"), size(lambda x: x > 0.6).alias("right"),
        F.filter("xs", lambda x, i: F.get("shares", i).between(0.4, 0.6)).alias("middle"), F.size("xs").alias("words"),
    )
    split = F.when(F.size("middle") > 0, _total(F.col("middle")) / F.size("middle"))
    two = (F.col("left") / F.col("words") > 0.3) & (F.col("right") / F.col("words") > 0.3)
    return out.select("page", "left", "right", F.size("middle").cast("long").alias("centre"), F.round(split, 6).alias("split"), two.alias("two_columns"))


def alignment(words: DataFrame, centres: DataFrame, within: int = 25) -> DataFrame:
    """Share of words near some column centre."""
    per_page = centres.groupBy("page").agg(F.collect_list("centre").alias("centres"))
    d = F.array_min(F.transform("centres", lambda c: F.abs(c - F.col("x0"))))
    return words.join(per_page, "page").groupBy("page").agg(F.round(F.avg(F.when(d < within, 1.0).otherwise(0.0)), 6).alias("score"))


def widest_gap(words: DataFrame, least: int = 50) -> DataFrame:
    """Where each line splits in two: at its first widest gap, if wide enough."""
    g = gaps(words).where(F.col("gap") > least)
    return g.groupBy("page", "line").agg(F.max(F.struct("gap", (-F.col("word_id")).alias("w"))).alias("m")).select("page", "line", "m.gap", (-F.col("m.w")).alias("split_before"))


def page_structure(words: DataFrame, classes: DataFrame) -> DataFrame:
    """Flags per page: titles, table lines, horizontal extent."""
    extent = words.groupBy("page").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.countDistinct("line").alias("lines"))
    flags = classes.groupBy("page").agg(F.count_if(F.col("class") == "table").alias("table_lines"), F.count_if(F.col("class") == "title").alias("title_lines"))
    return extent.join(flags, "page").withColumn("has_table", F.col("table_lines") > 3)


def page_columns(words: DataFrame, width: int) -> DataFrame:
    """Two columns on a page of ``width``: the words begin within 60 percent of it, at more
    than ten places, and 15 percent of it lie free between two of them."""
    per_page = words.groupBy("page").agg(F.array_sort(F.collect_set(F.when(F.col("x0") > 0, F.col("x0")))).alias("xs"))
    free = F.array_max(F.zip_with(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.slice("xs", 1, F.greatest(F.size("xs") - 1, F.lit(0))), lambda b, a: b - a))
    two = (F.array_max("xs") - F.array_min("xs") < 0.6 * width) & (F.size("xs") > 10) & (free > 0.15 * width)
    return per_page.select("page", F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("column_count"))


def aligned_lines(words: DataFrame, within: int = 20) -> DataFrame:
    """Neighbouring lines that begin words at like places: the first such pair of a page by
    any of its words, later ones by the upper line's first word. Over three make a table."""
    order = Window.partitionBy("page").orderBy("line")
    lines = words.groupBy("page", "line").agg(F.array_sort(F.collect_set("x0")).alias("xs")).withColumn("below", F.lead("xs").over(order))
    meets = lambda x: F.exists("below", lambda b: F.abs(b - x) < within)
    pairs = lines.where("below IS NOT NULL").select("page", "line", meets(F.get("xs", F.lit(0))).alias("by_first"), F.exists("xs", meets).alias("by_any"))
    first = F.min(F.when(F.col("by_any"), F.col("line"))).over(Window.partitionBy("page"))
    counted = pairs.withColumn("first", first).groupBy("page").agg(F.count_if((F.col("line") == F.col("first")) | (F.col("by_first") & (F.col("line") > F.col("first")))).alias("aligned"))
    return counted.withColumn("has_table", F.col("aligned") > 3)


def multicolumn(words: DataFrame, first_lines: int = 20) -> DataFrame:
    """Pages in columns, by their first lines: 30 to 70 percent of the words stand left
    of the middle, or over 30 percent of the lines have words on both sides."""
    head = _pages(words).select("page", F.filter("words", lambda w: w["line"] < first_lines).alias("head")).where(F.size("head") > 0)
    half = head.withColumn("half", F.array_max(F.transform("head", lambda w: w["x1"])) / 2)
    left = lambda w: F.coalesce(w["x0"] < F.col("half"), F.lit(False))
    sides = half.select("page", "head", F.filter("head", left).alias("lefts"), F.filter("head", lambda w: ~left(w)).alias("rights"))
    lines = lambda ws: F.array_distinct(F.transform(ws, lambda w: w["line"]))
    shares = sides.select(
        "page", F.size("head").cast("long").alias("words"), (F.size("lefts") / F.size("head")).alias("left_share"),
        (F.size(F.array_intersect(lines("lefts"), lines("rights"))) / F.size(lines("head"))).alias("two_sided"),
    )
    several = (F.col("words") >= 10) & (F.col("left_share").between(0.3, 0.7) | (F.col("two_sided") > 0.3))
    return shares.select("page", "words", F.round("left_share", 6).alias("left_share"), F.round("two_sided", 6).alias("two_sided"), several.alias("multicolumn"))


def table_line_scores(words: DataFrame, tolerance: int = 5) -> DataFrame:
    """Per line its wide gaps, the share of its words that stand under or over a word of
    a neighbouring line, and whether it looks like a table's."""
    w = Window.partitionBy("page", "line").orderBy("x0", "word_id")
    lines = words.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).groupBy("page", "line").agg(
        F.sort_array(F.collect_list("x0")).alias("xs"), F.count_if(F.col("gap") > TABLE_GAP).alias("wide_gaps"), F.count(F.lit(1)).alias("words"),
        (F.sum(F.length(F.regexp_replace("text", "[^0-9]", ""))) / F.sum(F.length("text") + 1)).alias("digit_share"),
    )
    p = Window.partitionBy("page").orderBy("line")
    none = F.array().cast("array<int>")
    near = lines.withColumn("near", F.concat(F.coalesce(F.lag("xs").over(p), none), F.coalesce(F.lead("xs").over(p), none)))
    aligned = F.size(F.filter("xs", lambda x: F.exists("near", lambda y: F.abs(y - x) <= tolerance))) / F.size("xs")
    scored = near.withColumn("aligned", aligned)
    table = (F.col("wide_gaps") >= 2) | ((F.col("words") >= TABLE_WORDS) & (F.col("digit_share") > 0.25)) | ((F.col("words") >= 2) & (F.col("aligned") > 0.6))
    return scored.select("page", "line", "wide_gaps", F.round("aligned", 6).alias("aligned"), table.alias("is_table"))


def table_zones(words: DataFrame, least_words: int = TABLE_WORDS, least_gap: int = 15) -> DataFrame:
    """Boxes of lines with enough words that stand far enough apart on average."""
    w = Window.partitionBy("page", "line").orderBy("x0", "word_id")
    lines = words.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).groupBy("page", "line").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.avg("gap").alias("mean_gap"), F.count(F.lit(1)).alias("n")
    )
    return lines.where((F.col("n") >= least_words) & (F.col("mean_gap") > least_gap)).drop("n").withColumn("mean_gap", F.round("mean_gap", 6))


def line_columns(words: DataFrame, columns: int = 2) -> DataFrame:
    """Each line's text in one of equally wide columns, by its mean x0."""
    pages = _pages(words).select("page", "words", F.array_max(F.transform("words", lambda w: w["x1"])).alias("width"))
    x = _total(F.transform("words", lambda w: w["x0"])) / F.size("words")
    return _by_line(pages, "width").select("page", "line", F.least(F.lit(columns - 1), F.floor(x / (F.col("width") / columns))).cast("int").alias("column"), _joined(F.col("words")).alias("text"))


def column_sides(words: DataFrame, middle: int) -> DataFrame:
    """Each line's text left and right of the middle."""
    lines = _by_line(_pages(words))
    side = lambda name, ok: F.struct(F.lit(name).alias("side"), F.filter("words", ok).alias("words"))
    left = lambda w: F.coalesce(w["x0"] < middle, F.lit(False))
    sides = lines.select("page", "line", F.explode(F.array(side("left", left), side("right", lambda w: ~left(w)))).alias("s")).where(F.size("s.words") > 0)
    return sides.select("page", "s.side", "line", _joined(F.col("s.words")).alias("text"))


def first_word_with(cells: DataFrame, words: DataFrame) -> DataFrame:
    """For each ``(page, cell)`` the first word of its page that contains the cell's text."""
    met = cells.join(words.select("page", "word_id", "text"), "page").where(F.contains(F.col("text"), F.col("cell")))
    return met.groupBy("page", "cell").agg(F.min("word_id").alias("word_id"))


def scale_boxes(words: DataFrame, image: tuple[int, int], page: tuple[int, int]) -> DataFrame:
    """Boxes from image to page coordinates, truncated."""
    sx, sy = page[0] / image[0], page[1] / image[1]
    f = lambda c, s: (F.col(c) * F.lit(s)).cast("int").alias(c)
    return words.select("page", "word_id", f("x0", sx), f("x1", sx), f("top", sy), f("bottom", sy))


def is_financial(c: Column) -> Column:
    """Mostly digits, or a leading digit, parentheses or a currency sign before one."""
    share = F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))
    return (share > 0.5) | F.regexp_like(c, F.lit(r"^\s*[0-9]|^\s*\([0-9]|^\s*[$€£]\s*[0-9]"))


def numeric_cell(c: Column) -> Column:
    return F.regexp_like(F.translate(c, ",$%()", ""), F.lit(r"^[0-9.-]*[0-9][0-9.-]*$"))


def pad_rows(rows: DataFrame) -> DataFrame:
    """Ragged table rows ``(table_id, row, cells)`` padded to the table's widest."""
    width = rows.groupBy("table_id").agg(F.max(F.size("cells")).alias("width"))
    return rows.join(width, "table_id").select("table_id", "row", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))).alias("cells"))


def quality(tables: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Per document 100, less 5 a broken table (rows of different width) and 0.05 an
    empty paragraph, within 0 and 100. ``tables (document, table_id, row, width)``,
    ``paragraphs (document, text)``."""
    per_table = tables.groupBy("document", "table_id").agg(F.countDistinct("width").alias("widths"))
    t = per_table.groupBy("document").agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("widths") > 1).alias("broken"))
    p = paragraphs.groupBy("document").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    both = p.join(t, "document", "left").na.fill(0, ["tables", "broken"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 5.0 * F.col("broken") - 0.05 * F.col("empty")))
    return both.withColumn("score", F.round(score, 6))


def page_chunks(pages: DataFrame, size: int) -> DataFrame:
    """The plan of chunks ``[first, last]`` over each document's page count."""
    return pages.select("document", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(size))).alias("first"), "pages").select("document", "first", F.least(F.col("first") + size, F.col("pages")).alias("end"))
