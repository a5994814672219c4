"""Page coordinates: who owns a figure, where an item stands, which box is which option.

Boxes are on one 0 to 1000 scale per page.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.choices import bound
from ..scale import last_seen, lag, lead, scan
from ..session import materialise

ANY_REF = r"!\[[^\]]*\]\([^)]*\)|!\[\[[^\]]+\]\]|<img\b[^>]*>"
HEAD_NUMBER = r"(?U)^\s*(\d{1,3})\s*[.．、]\s*"  # fixed value
SIGNATURE_LENGTH, SIGNATURE_MIN = 64, 12  # fixed values
MAX_CROP_PAGES, MAX_CROP_NUMBERS = 3, 4  # fixed values
FRACTION_MAX = 1.5


def normal_box(box: Column) -> Column:
    """Boxes given as page fractions are stretched to the 0 to 1000 scale."""
    small = F.array_max(F.transform(box, lambda v: F.abs(v))) <= FRACTION_MAX
    scaled = F.transform(box, lambda v: F.when(small, v * 1000.0).otherwise(v.cast("double")))
    return F.when(F.size(box) == 4, scaled)


def page_chunk(page: str = "page", per_chunk: int = 64) -> Column:
    return F.floor(F.col(page) / per_chunk).cast("long")


def figure_owners(headers: DataFrame, figures: DataFrame) -> DataFrame:
    """Number of the last header on the figure's page whose top is not below the figure's."""
    h = headers.select("doc", "page", F.col("top").cast("double").alias("y"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("figure"), F.col("number").cast("long").alias("number"))
    f = figures.select("doc", "page", F.col("top").cast("double").alias("y"), F.lit(1).alias("k"), F.col("figure").cast("string").alias("figure"), F.lit(None).cast("long").alias("number"))
    rows = h.unionByName(f).withColumn("_band", F.floor(F.col("y") / 250).cast("long"))
    at = scan(rows.withColumn("number", F.col("number")), ["doc", "page"], ["y", "k", "number", "figure"], "_band", {"owner": last_seen(F.col("number"))})
    return at.filter("k = 1 AND owner IS NOT NULL").select("doc", "page", "figure", "owner")


def contained_owner(headers: DataFrame, figures: DataFrame, ends: DataFrame) -> DataFrame:
    """Owner of each figure that lies wholly between one header and the next, across pages.

    ``headers(doc, page, top, number)``, ``figures(doc, figure, page, top, bottom)``,
    ``ends(doc, page, top)`` closes the last interval. Documents whose numbers or places do
    not rise strictly are left out.
    """
    place = lambda p, y: F.struct(F.col(p).cast("long").alias("p"), F.col(y).cast("double").alias("y"))
    h = headers.select("doc", F.col("number").cast("long").alias("number"), place("page", "top").alias("at"), "page")
    by_number = scan(h.withColumn("_c", F.floor(F.col("number") / 4096)), ["doc"], ["number", "at"], "_c", {"pn": lag(F.col("number")), "pat": lag(F.col("at"))})
    bad = by_number.filter((F.col("pn") == F.col("number")) | (F.col("pat") >= F.col("at"))).select("doc").distinct()
    good = h.join(bad, "doc", "left_anti")
    marks = good.select("doc", "at", F.lit(0).alias("k"), "number", F.lit(None).cast("string").alias("figure"), F.lit(None).cast("struct<p:bigint,y:double>").alias("bottom"))
    figs = figures.select("doc", place("page", "top").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("number"),
                          F.col("figure").cast("string").alias("figure"), place("page", "bottom").alias("bottom"))
    steps = scan(good.withColumn("_c", page_chunk()), ["doc"], ["at"], "_c", {"next_at": lead(F.col("at"))})
    nexts = steps.select("doc", "number", "next_at")
    rows = marks.unionByName(figs).withColumn("_c", F.floor(F.col("at.p") / 64).cast("long"))
    owned = scan(rows, ["doc"], ["at", "k", "figure"], "_c", {"owner": last_seen(F.col("number"))}).filter("k = 1 AND owner IS NOT NULL")
    last = ends.groupBy("doc").agg(F.min(place("page", "top")).alias("_end"))
    j = owned.join(nexts.withColumnRenamed("number", "owner"), ["doc", "owner"]).join(last, "doc", "left")
    return j.filter(F.col("bottom") < F.coalesce("next_at", "_end")).select("doc", "figure", "owner")


def outside_crops(figures: DataFrame, crops: DataFrame) -> DataFrame:
    """Figures that touch no crop of their page."""
    c = crops.select("doc", "page", F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    hit = figures.join(c, ["doc", "page"]).filter((F.col("bottom") >= F.col("_t")) & (F.col("top") <= F.col("_b"))).select("doc", "figure").distinct()
    ok = figures.filter((F.col("top") >= 0) & (F.col("top") < F.col("bottom")) & (F.col("bottom") <= 1000))
    return ok.join(hit, ["doc", "figure"], "left_anti")


def return_figures(figures: DataFrame, crops: DataFrame, headers: DataFrame, ends: DataFrame, items: DataFrame) -> DataFrame:
    """Figures outside the crops that go back to the existing item owning them."""
    out = outside_crops(figures, crops)
    own = contained_owner(headers, out, ends)
    have = items.select("doc", F.col("number").cast("long").alias("owner")).distinct()
    return own.join(have, ["doc", "owner"], "left_semi")


def signature(text: Column) -> Column:
    """Letters and digits only, lower case, without the item number."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, HEAD_NUMBER, ""), r"[^\p{L}\p{N}]", ""))


def resolve_anchors(items: DataFrame, layout: DataFrame) -> DataFrame:
    """The one layout question of an item's number whose text starts with its signature.

    Items with a short signature fall back to the number, where it is unique in the document.
    """
    i = items.select("doc", "item", "number", F.left(signature(F.col("text")), F.lit(SIGNATURE_LENGTH)).alias("sig"))
    q = layout.select("doc", "question", "number", signature(F.col("text")).alias("lsig"))
    long = (i.filter(F.length("sig") >= SIGNATURE_MIN).join(q, ["doc", "number"])
            .filter(F.startswith("lsig", F.col("sig")) | F.startswith("sig", F.col("lsig")) & (F.length("lsig") >= SIGNATURE_MIN)))
    short = i.filter(F.length("sig") < SIGNATURE_MIN).join(q, ["doc", "number"])
    per = (long.unionByName(short).groupBy("doc", "item").agg(F.count("*").alias("_n"), F.min("question").alias("question")))
    return per.filter("_n = 1").drop("_n")


def locate_on_pages(items: DataFrame, pages: DataFrame, gram: int = 24) -> DataFrame:
    """Page that alone contains an item's text.

    Instead of comparing every item with every page, both sides meet on the hash of a
    character run: the item's first ``gram`` characters and every run of the page, of which
    the item needs one. The full text decides.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    i = items.select("item", key(F.col("text")).alias("sig")).filter(F.length("sig") >= gram)
    p = pages.select("page", key(F.col("text")).alias("body"))
    runs = p.select("page", "body").mapInPandas(_gram_hashes(gram), "page long, h long")
    first = i.select("item", "sig", F.left("sig", F.lit(gram)).alias("g")).mapInPandas(_first_hash(gram), "item long, sig string, h long")
    # keep only page runs some item asks for, then fetch the page text once per hit
    hits = first.join(runs, "h").select("item", "sig", "page").distinct()
    sure = hits.join(p, "page").filter(F.contains("body", F.col("sig")))
    return sure.groupBy("item").agg(F.count("*").alias("pages"), F.min("page").alias("page")).filter("pages = 1").drop("pages")


def _roll(text: str, n: int):
    import numpy as np
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - n + 1 + k]
    return h.astype(np.int64)


def _gram_hashes(n: int):
    def run(batches):
        import numpy as np
        for pdf in batches:
            for page, body in zip(pdf["page"], pdf["body"]):
                h = np.unique(_roll(body, n))
                yield pd.DataFrame({"page": np.full(len(h), page), "h": h})
    return run


def _first_hash(n: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["item"], "sig": pdf["sig"], "h": [int(_roll(g, n)[0]) for g in pdf["g"]]})
    return run


# Window lengths, the step between their starts, and how much of an item they cover.
WINDOW_LENGTHS, WINDOW_STEP, LAST_START, KEY_LENGTH = (64, 48, 40, 32), 16, 96, 192
CORE = 16  # characters of a fingerprint; a window of 32 holds 17 of them and shares their least with every page it is on
SHORT_BITS = 20


def page_key(text: str) -> tuple[str, str]:
    """Letters and digits of the NFKC form in lower case, and the ideographs among them."""
    import unicodedata
    key = "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if c.isalnum())
    return key, "".join(c for c in key if "\u3400" <= c <= "\u9fff")


def _least(h, span: int):
    """Places whose value is the least of ``span`` neighbours for some window (the last of equal ones)."""
    import numpy as np
    if len(h) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return np.unique(np.arange(len(view)) + span - 1 - view[:, ::-1].argmin(axis=1))


def locate_by_windows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """The page an item is on, by votes of its windows: item, page, votes.

    Windows of 64 to 32 characters from the first part of an item vote for the page that alone
    holds them; an item is placed if all votes name one page, so a misread character or a
    differing head costs some windows only. Ideographs make a key of their own, which survives
    formulas read differently. An item of fewer than 32 characters votes with its whole key.

    Pages are not compared with items. Both sides select fingerprints by one rule (the least of
    17 runs of 16 characters), so an item's window and every page that holds it share one; the
    characters decide. Runs for short items are made for the lengths that occur, sieved by a
    table of bits of fixed size before they leave the task.
    """
    spark = items.sparkSession
    keys = "long, kind int, key string"

    def keyed(name):
        def run(batches):
            for pdf in batches:
                rows = [(i, kind, key) for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for kind, key in enumerate(page_key(text)) if key]
                yield pd.DataFrame(rows, columns=[name, "kind", "key"])
        return run

    i = materialise(items.select(F.col("item").cast("long"), F.regexp_replace(F.coalesce("text", F.lit("")), HEAD_NUMBER, "").alias("text")).mapInPandas(keyed("item"), f"item {keys}"))
    p = materialise(pages.select(F.col("page").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(keyed("page"), f"page {keys}"))
    long = i.groupBy("item").agg((F.max(F.length("key")) >= WINDOW_LENGTHS[-1]).alias("_long"))
    i = materialise(i.join(long, "item"))

    def windows(batches):
        for pdf in batches:
            rows = []
            for item, kind, key in zip(pdf["item"], pdf["kind"], pdf["key"]):
                key = key[:KEY_LENGTH]
                found = {key[s:s + n] for n in WINDOW_LENGTHS for s in range(0, min(len(key) - n, LAST_START) + 1, WINDOW_STEP)}
                for w in found:
                    h = _roll(w[:WINDOW_LENGTHS[-1]], CORE).view("uint64")
                    at = len(h) - 1 - int(h[::-1].argmin())
                    rows.append((item, kind, w, at, int(h[at].view("int64"))))
            yield pd.DataFrame(rows, columns=["item", "kind", "w", "off", "h"])

    def prints(batches):
        for pdf in batches:
            for page, kind, key in zip(pdf["page"], pdf["kind"], pdf["key"]):
                h = _roll(key, CORE).view("uint64")
                at = _least(h, WINDOW_LENGTHS[-1] - CORE + 1)
                yield pd.DataFrame({"page": [page] * len(at), "kind": [kind] * len(at), "at": at, "h": h[at].view("int64")})

    asked = materialise(i.filter("_long").mapInPandas(windows, "item long, kind int, w string, off long, h long"))
    marks = p.mapInPandas(prints, "page long, kind int, at long, h long")
    met = asked.select("kind", "w", "off", "h").distinct().join(marks, ["kind", "h"]).select("kind", "w", "page", (F.col("at") - F.col("off")).alias("start"))
    held = (met.filter("start >= 0").join(p, ["page", "kind"]).filter(F.substr("key", (F.col("start") + 1).cast("int"), F.length("w")) == F.col("w"))
            .groupBy("kind", "w").agg(F.min("page").alias("page"), F.max("page").alias("_other")).filter("page = _other").drop("_other"))

    short = i.filter("NOT _long AND kind = 0").select("item", "key")
    sizes = sorted(r.n for r in short.select(F.length("key").alias("n")).distinct().collect())  # fewer than 32 numbers
    votes = asked.join(held, ["kind", "w"]).select("item", "page")
    if sizes:
        def own(batches):
            for pdf in batches:
                yield pd.DataFrame({"item": pdf["item"], "key": pdf["key"], "n": pdf["key"].str.len(), "h": [int(_roll(k, len(k))[0]) for k in pdf["key"]]})

        wanted = materialise(short.mapInPandas(own, "item long, key string, n long, h long"))
        flags = np_flags([r.b for r in wanted.select(F.shiftrightunsigned("h", 64 - SHORT_BITS).alias("b")).distinct().collect()])  # at most 2^SHORT_BITS

        def runs(batches):
            import numpy as np
            for pdf in batches:
                for page, key in zip(pdf["page"], pdf["key"]):
                    for n in sizes:
                        h = np.unique(_roll(key, n))
                        h = h[flags[(h.view("uint64") >> np.uint64(64 - SHORT_BITS)).astype("int64")]]
                        if len(h):
                            yield pd.DataFrame({"page": [page] * len(h), "n": [n] * len(h), "h": h})

        hits = wanted.join(p.filter("kind = 0").mapInPandas(runs, "page long, n long, h long"), ["n", "h"]).select("item", F.col("key").alias("w"), "page")
        sure = hits.join(p.filter("kind = 0"), "page").filter(F.contains("key", F.col("w")))
        votes = votes.unionByName(sure.groupBy("item").agg(F.min("page").alias("page"), F.max("page").alias("_other")).filter("page = _other").drop("_other"))
    per = votes.groupBy("item").agg(F.min("page").alias("page"), F.max("page").alias("_other"), F.count("*").alias("votes"))
    return per.filter("page = _other").drop("_other")


def np_flags(places: list[int]):
    import numpy as np
    out = np.zeros(1 << SHORT_BITS, dtype=bool)
    out[places] = True
    return out


def align_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Start of each page in its document's text, where the first block of every page occurs
    once and the starts rise; other documents are left to review (``aligned`` false).

    The pages of a document travel as one array, so its text is not repeated for each.
    """
    per = pages.groupBy("doc").agg(F.collect_list(F.struct("page", "first_block")).alias("_p"))
    j = per.join(docs.select("doc", F.col("text").alias("_doc")), "doc")
    once = "instr(_doc, p.first_block) > 0 AND locate(p.first_block, _doc, instr(_doc, p.first_block) + 1) = 0"
    found = F.expr(f"transform(_p, p -> struct(p.page AS page, CASE WHEN {once} THEN instr(_doc, p.first_block) END AS at))")
    spots = materialise(j.select("doc", F.inline(found)))
    step = scan(spots.withColumn("_c", page_chunk("page", 4096)), ["doc"], ["page"], "_c", {"_p": lag(F.coalesce("at", F.lit(-1)))})
    ok = step.groupBy("doc").agg(F.bool_and(F.col("at").isNotNull() & (F.col("_p").isNull() | (F.col("_p") < F.col("at")))).alias("aligned"))
    return spots.join(ok, "doc").withColumn("at", F.when(F.col("aligned"), F.col("at")))


def best_layout_file(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Per source the layout file with the right page count and most unique hits, then fewest
    ambiguous ones, then the better format."""
    fit = files.filter("pages = source_pages")
    per = anchors.groupBy("source", "file").agg(F.count_if("unique_hit").alias("hits"), F.count_if(~F.col("unique_hit")).alias("ambiguous"))
    j = fit.join(per, ["source", "file"], "left").fillna(0, ["hits", "ambiguous"])
    return j.groupBy("source").agg(F.max_by("file", F.struct("hits", -F.col("ambiguous"), -F.col("format_rank"), "file")).alias("file"), F.max("hits").alias("hits"))


def plan_crops(missing: DataFrame, anchors: DataFrame) -> DataFrame:
    """Page slices to read again for runs of missing numbers.

    ``missing(doc, number)``, ``anchors(doc, number, page, top)``. A run of at most four
    numbers needs an anchor before and after it, in order and at most three pages apart.
    """
    m = missing.select("doc", F.col("number").cast("long").alias("number"))
    step = scan(m.withColumn("_c", F.floor(F.col("number") / 4096)), ["doc"], ["number"], "_c", {"_p": lag(F.col("number"))})
    opened = materialise(step.withColumn("_open", F.when(F.coalesce(F.col("number") - F.col("_p"), F.lit(0)) != 1, F.col("number"))))
    runs = scan(opened, ["doc"], ["number"], "_c", {"first": last_seen(F.col("_open"))})
    per = runs.groupBy("doc", "first").agg(F.max("number").alias("last")).filter(F.col("last") - F.col("first") < MAX_CROP_NUMBERS)
    a = anchors.select("doc", (F.col("number") + 1).cast("long").alias("first"), F.col("page").alias("p1"), F.col("top").alias("t1"))
    b = anchors.select("doc", (F.col("number") - 1).cast("long").alias("last"), F.col("page").alias("p2"), F.col("top").alias("t2"))
    j = per.join(a, ["doc", "first"]).join(b, ["doc", "last"])
    ordered = F.struct("p1", "t1") < F.struct("p2", "t2")
    j = j.filter(ordered & (F.col("p2") - F.col("p1") < MAX_CROP_PAGES)).withColumn("page", F.explode(F.sequence("p1", "p2")))
    top = F.when(F.col("page") == F.col("p1"), F.col("t1")).otherwise(F.lit(0.0))
    bottom = F.when(F.col("page") == F.col("p2"), F.col("t2")).otherwise(F.lit(1000.0))
    return j.select("doc", "first", "last", "page", top.alias("top"), bottom.alias("bottom"))


def right_column_figures(figures: DataFrame, middle: float = 500.0) -> DataFrame:
    """Text width left of the figures, for documents whose figures (two or more, one page)
    all stand right of the middle."""
    center = (F.col("x0") + F.col("x1")) / 2
    per = figures.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"), F.min(center).alias("c"), F.min("x0").alias("left"))
    return per.filter((F.col("n") >= 2) & (F.col("pages") == 1) & (F.col("c") > middle)).select("doc", (F.col("left") / 1000).alias("ratio"))


ASSIGNED = "doc {doc}, item {item}, label string, figure string"
SIZE_RATIO, AREA_RATIO = 1.35, 1.65  # fixed values
ACCEPT_MEAN, CENTER_WEIGHT, SPAN_X, SPAN_Y = 235.0, 0.16, 950.0, 650.0  # fixed values
ASPECT_WEIGHT, AREA_WEIGHT, NEAREST = 55.0, 35.0, 3  # fixed values
ITEM = ["doc", "item"]


def _shaped(figures: DataFrame) -> DataFrame:
    """Figures as structs with centre, size and logarithms of aspect and area."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return figures.select(*ITEM, F.struct(
        "figure", "page", "x0", "y0", "x1", "y1", w.alias("w"), h.alias("h"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        F.when((w > 0) & (h > 0), F.log(w / h)).alias("aspect"), F.when((w > 0) & (h > 0), F.log(w * h)).alias("area")).alias("b"))


def _lined(boxes: Column, tolerance: Column) -> Column:
    """Boxes in reading order, each with the line it stands in.

    Going down the page a box joins the line above if its centre is within the tolerance of
    that line's mean centre, else it begins a line.
    """
    down = F.array_sort(F.transform(boxes, lambda b: F.struct(b["cy"].alias("cy"), b["figure"].alias("figure"), b.alias("b"))))
    empty = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.filter(F.transform(down, lambda d: F.struct(F.lit(0).alias("line"), d["b"]["cx"].alias("cx"), d["figure"].alias("figure"), d["b"].alias("b"))), lambda d: F.lit(False)).alias("done"))

    def place(state, d):
        same = (state["n"] > 0) & (F.abs(d["cy"] - state["sum"] / F.greatest(state["n"], F.lit(1))) <= tolerance)
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        row = F.struct(line.alias("line"), d["b"]["cx"].alias("cx"), d["figure"].alias("figure"), d["b"].alias("b"))
        return F.struct(line.alias("line"), (F.when(same, state["sum"]).otherwise(F.lit(0.0)) + d["cy"]).alias("sum"), (F.when(same, state["n"]).otherwise(F.lit(0)) + 1).alias("n"), F.concat(state["done"], F.array(row)).alias("done"))

    return F.array_sort(F.aggregate(down, empty, place, lambda s: s["done"]))


def _letters(picked: DataFrame) -> DataFrame:
    return picked.select(*ITEM, F.posexplode("four").alias("k", "figure")).select(*ITEM, F.char(F.col("k") + 65).alias("label"), "figure")


def _reading_order(figures: DataFrame) -> DataFrame:
    """Items with exactly four figures, on one page: labels follow reading order."""
    four = (figures.groupBy(*ITEM).agg(F.count("*").alias("n"), F.count_distinct("b.page").alias("pages")).filter("n = 4 AND pages = 1").select(*ITEM))
    per = figures.join(four, ITEM, "left_semi").groupBy(*ITEM).agg(F.collect_list("b").alias("boxes"))
    heights = F.array_sort(F.transform("boxes", lambda b: b["h"]))
    tolerance = F.greatest(F.lit(20.0), (heights[1] + heights[2]) * 0.225)
    return _letters(per.select(*ITEM, F.transform(_lined(F.col("boxes"), tolerance), lambda r: r["figure"]).alias("four")))


def _grids(figures: DataFrame) -> DataFrame:
    """Every four figures of an item that form a regular grid, in reading order.

    Figures are joined one by one; two figures of one grid differ little in size, so most
    pairs end at the first join.
    """
    good = figures.filter("b.w > 0 AND b.h > 0")

    def alike(x, y):
        ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
        return ((x["page"] == y["page"]) & (x["figure"] < y["figure"]) & (ratio(x["w"], y["w"]) <= SIZE_RATIO) & (ratio(x["h"], y["h"]) <= SIZE_RATIO)
                & (ratio(x["w"] * x["h"], y["w"] * y["h"]) <= AREA_RATIO))

    rows = good.withColumnRenamed("b", "b0")
    for k in (1, 2, 3):
        rows = rows.join(good.withColumnRenamed("b", f"b{k}"), ITEM).filter(alike(F.col(f"b{k - 1}"), F.col(f"b{k}")))
        for j in range(k - 1):
            rows = rows.filter(alike(F.col(f"b{j}"), F.col(f"b{k}")))
    rows = rows.select(*ITEM, F.array("b0", "b1", "b2", "b3").alias("boxes"))
    third = lambda name: F.array_sort(F.transform("boxes", lambda b: b[name]))[2]
    spread = lambda name: F.array_max(F.transform("boxes", lambda b: b[name])) - F.array_min(F.transform("boxes", lambda b: b[name]))
    slack = F.struct(F.greatest(F.lit(20.0), 0.35 * third("h")).alias("high"), F.greatest(F.lit(25.0), 0.45 * third("w")).alias("wide"))

    def regular(r, s):
        x = lambda i: r[i]["cx"]
        fine = bound(F.array_join(F.transform(r, lambda v: v["line"].cast("string")), ""), lambda lines: (
            F.when(lines == "0000", spread("cy") <= s["high"])
            .when(lines == "0011", (F.abs(x(0) - x(2)) <= s["wide"]) & (F.abs(x(1) - x(3)) <= s["wide"]))
            .when(lines == "0123", spread("cx") <= s["wide"]).otherwise(False)))
        return F.when(fine, F.transform(r, lambda v: v["figure"]))

    four = bound(slack, lambda s: bound(_lined(F.col("boxes"), s["high"]), lambda r: regular(r, s)))
    # no Filter, which the engine would move below the columns and so compute them again for it
    return rows.select(*ITEM, F.explode(F.filter(F.array(four), lambda f: f.isNotNull())).alias("four"))


def _unique_grid(figures: DataFrame) -> DataFrame:
    """Items with one regular grid of four among their figures, and no second one."""
    found = _grids(figures).groupBy(*ITEM).agg(F.count("*").alias("n"), F.first("four").alias("four"))
    return _letters(found.filter("n = 1"))


def _least_cost(figures: DataFrame, anchors: DataFrame) -> DataFrame:
    """Figures for A to D with the least total distance to their printed labels.

    A label's printed places on a page are cut to the ``NEAREST`` to the middle of its
    figures. Each place and figure is a candidate with its cost; the four letters are joined
    in turn. No part of an accepted whole costs more than the whole may, so what exceeds
    that on the way is dropped without loss.
    """
    most = 4 * ACCEPT_MEAN
    page = figures.groupBy(*ITEM, F.col("b.page").alias("page")).agg(F.count("*").alias("n"), F.avg("b.cx").alias("mx"), F.avg("b.cy").alias("my")).filter("n >= 4").drop("n")
    near = Window.partitionBy(*ITEM, "page", "label").orderBy("far", "x", "y")
    marks = (anchors.join(page, [*ITEM, "page"]).withColumn("far", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
             .withColumn("k", F.row_number().over(near)).filter(F.col("k") <= NEAREST).select(*ITEM, "page", "label", "x", "y"))
    dx = F.greatest(F.col("b.x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("b.x1"))
    dy = F.greatest(F.col("b.y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("b.y1"))
    cost = F.hypot(dx, dy) + CENTER_WEIGHT * F.hypot(F.col("x") - F.col("b.cx"), F.col("y") - F.col("b.cy"))
    options = marks.join(figures.withColumn("page", F.col("b.page")), [*ITEM, "page"]).withColumn("cost", cost).filter(F.col("cost") <= most)
    # of several places of a label the choice also depends on the span, so all are kept
    whole = None
    for letter in "ABCD":
        one = options.filter(F.col("label") == letter).select(*ITEM, "page", F.struct("x", "y", "b", "cost").alias(letter))
        if whole is None:
            whole = one.withColumn("total", F.col("A.cost"))
            continue
        whole = whole.join(one, [*ITEM, "page"]).withColumn("total", F.col("total") + F.col(f"{letter}.cost")).filter(F.col("total") <= most)
        for other in "ABCD"[:"ABCD".index(letter)]:
            whole = whole.filter((F.col(f"{other}.b.figure") != F.col(f"{letter}.b.figure"))
                                 & (F.abs(F.col(f"{other}.x") - F.col(f"{letter}.x")) <= SPAN_X) & (F.abs(F.col(f"{other}.y") - F.col(f"{letter}.y")) <= SPAN_Y))
    four = F.array("A.b", "B.b", "C.b", "D.b")

    def uneven(name):
        values = F.transform(four, lambda b: b[name])
        return F.aggregate(F.transform(values, lambda v: F.abs(v - F.array_sort(values)[2])), F.lit(0.0), lambda a, v: a + v)

    total = F.col("total") + ASPECT_WEIGHT * uneven("aspect") + AREA_WEIGHT * uneven("area")
    named = whole.select(*ITEM, F.struct(total.alias("cost"), "page", F.transform(four, lambda b: b["figure"]).alias("four")).alias("v")).filter(F.col("v.cost") <= most)
    return _letters(named.groupBy(*ITEM).agg(F.min("v").alias("v")).select(*ITEM, F.col("v.four").alias("four")))


def assign_options(figures: DataFrame, anchors: DataFrame | None, mode: str) -> DataFrame:
    """(doc, item, label, figure) for items whose figures can be told apart.

    ``reading``: four figures in reading order; ``grid``: the only regular four of N;
    ``cost``: least distance to the printed labels. Items whose layout decides nothing go
    unassigned; of equal costs the least page and figure names win.
    """
    boxes = _shaped(figures)
    if mode == "reading":
        return _reading_order(boxes)
    return _unique_grid(boxes) if mode == "grid" else _least_cost(boxes, anchors)
