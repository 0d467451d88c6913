"""HTML extraction by wrapper induction over the pages of a host.

1. Every page gives the outline of its tree and the digests of its blocks.
2. Pages of a host with the same layout form a group, layouts of few pages join
   the host's commonest. Simple tree matching aligns each page with the first of
   its group. Nodes that are constant over the group become template; the slot
   that holds what varies, boilerplate apart, becomes the group's wrapper.
3. Every page is read again: what the wrapper holds, less template and boilerplate.
   A page that no wrapper fits gives what it marks as its article, or all of it.

Only outlines, templates and wrappers move, never the pages' html, as long as
Spark finds the table of templates small enough to broadcast; else it joins by
host, and adaptive execution splits the hosts with very many pages.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm import dom
from fleetspark.llm.common import scratch, ship, written
from fleetspark.llm.urls import with_host_and_path


@dataclass(frozen=True)
class Settings:
    """A node is template if it is constant on ``share`` of the pages it is matched on, ``pages`` at least; as many show a slot.

    In marked articles, and on pages without a mark, copies of one text count as
    one page. An article that has the share ``alike`` of its phrases in common
    with the first page's is no evidence on what is template in it.
    """

    share: float = 0.8
    pages: int = 3
    alike: float = 0.3


_PAGE = "layout long, depth array<int>, label array<string>, node array<long>, digest array<long>, kind array<int>, mass array<long>, marked boolean, article long, path array<long>, block array<long>, sample array<long>"
_SHAPE = ("depth", "label", "node", "digest", "kind", "mass", "marked", "article", "path", "block", "sample")


def skeletons(pages: DataFrame) -> DataFrame:
    """``host, page_id`` and what ``dom.page`` tells of each page: its outline and its blocks in arrays, in page order."""

    def run(batches):
        for batch in batches:
            found = [dom.page(dom.parse(h or "")) for h in batch.column("html").to_pylist()]
            longs = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            columns = [pa.array([dom.layout(p[0]) for p in found], pa.int64())]
            for name, kind in (("depth", pa.int32()), ("label", pa.string()), ("path", pa.int64()), ("digest", pa.int64()), ("kind", pa.int32()), ("mass", pa.int64())):
                columns.append(pa.array([[getattr(n, name) for n in p[0]] for p in found], pa.list_(kind)))
            columns += [pa.array([p[1] for p in found], pa.bool_()), pa.array([p[2] for p in found], pa.int64())]
            columns += [longs([[n[k] for n in p[3]] for p in found]) for k in (0, 1)] + [longs([p[4] for p in found])]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), *columns], ["host", "page_id", "layout", *_SHAPE])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("host", "page_id", "html").mapInArrow(run, f"host string, page_id {kind}, {_PAGE}")


def evidence(first: dict, page: dict, alike: float):
    """(place in the outline or -1, digest, text that counts once or None, same, differing text) for what ``first`` has and ``page`` has too.

    Places are of nodes that simple tree matching aligns; -1 is for blocks at the
    same path, wherever they stand.
    """
    unlike = first["article"] == page["article"] or not (first["marked"] and page["marked"]) or dom.likeness(first["sample"], page["sample"]) < alike
    a, b = (list(zip(p["depth"], p["label"], p["digest"], strict=True)) for p in (first, page))
    for i, j in dom.matched(a, b):
        within = first["kind"][i] & (dom.HOLDS | dom.MARKED | dom.WITHIN)
        same = int(a[i][2] == b[j][2])
        if unlike or not within:
            yield i, a[i][2], page["article"] if within or not page["marked"] else None, same, 0 if same else page["mass"][j]
        elif not same:  # near copies don't tell what is template, but where the text is
            yield i, 0, page["article"], 0, page["mass"][j]
    if not unlike:
        return
    paths, blocks = set(page["path"]), set(page["block"])
    for path, block in zip(first["path"], first["block"], strict=True):
        if path in paths:
            yield -1, block, page["article"], int(block in blocks), 0


def templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``host, template, wrappers``: digests of the constant nodes of the first page of each of the host's layouts, and
    the paths of the slots that hold the layouts' content.

    Pages without elements are left out. A layout of fewer than ``pages`` pages
    can't show what is constant: its pages are compared with the first page of
    the host's commonest layout.
    """
    trees = written(skeletons(pages)).where(F.size("label") > 1)
    order = F.struct("page_id", "article", "digest")
    layouts = trees.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min_by(F.struct(*_SHAPE), order).alias("first"), F.min(order).alias("_least"))
    common = layouts.groupBy("host").agg(F.min_by(F.struct("layout", "first"), F.struct(-F.col("n"), "_least")).alias("_common"))
    own = F.col("n") >= settings.pages
    choice = F.when(own, F.struct("layout", "first")).otherwise(F.col("_common"))
    first = written(layouts.join(common, "host").select("host", "layout", choice.alias("_c")).select("host", "layout", F.col("_c.layout").alias("group"), F.col("_c.first").alias("first")))

    def align(batches):
        for batch in batches:
            rows = [(host, group, *found) for host, group, first, page in zip(*(batch.column(c).to_pylist() for c in ("host", "group", "first", "page")), strict=True) for found in evidence(first, page, settings.alike)]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "group", "place", "digest", "once", "same", "mass"])

    key = ("host", "group", "place", "digest")
    aligned = trees.select("host", "layout", F.struct(*_SHAPE).alias("page")).join(first, ["host", "layout"]).select("host", "group", "first", "page")
    aligned = aligned.mapInArrow(align, "host string, group long, place int, digest long, once long, same long, mass long")
    counted = aligned.groupBy(*key, "once").agg(F.count("*").alias("n"), F.sum("same").alias("same"), F.max("same").alias("most"), F.sum("mass").alias("mass"), F.max("mass").alias("heaviest"))
    single = F.col("once").isNotNull()
    once = lambda one, all_: F.sum(F.when(single, one).otherwise(F.col(all_)))
    counted = written(counted.groupBy(*key).agg(once(F.lit(1), "n").alias("n"), once(F.col("most"), "same").alias("same"), once(F.col("heaviest"), "mass").alias("mass")))

    constant = counted.where((F.col("digest") != 0) & (F.col("n") >= settings.pages) & (F.col("same") >= settings.share * F.col("n")))
    # No more than a page has nodes, for each layout.
    template = constant.groupBy("host").agg(F.sort_array(F.collect_set("digest")).alias("template"))
    varying = counted.where("place >= 0 and mass > 0").groupBy("host", "group", "place").agg(F.sum("mass").alias("mass"), F.max("n").alias("n"))
    slots = varying.where(F.col("n") >= settings.pages).groupBy("host", "group").agg(F.collect_list("place").alias("places"), F.collect_list("mass").alias("masses"))
    tree = first.where("layout = group").select("host", "group", *[F.col(f"first.{c}").alias(c) for c in ("depth", "label", "node", "kind")])

    def induce(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("depth", "label", "node", "kind", "places", "masses")), strict=True)
            found = [dom.induced(list(zip(*parts, strict=True)), dict(zip(places, masses, strict=True))) for *parts, places, masses in rows]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.int64())], ["host", "wrapper"])

    induced = tree.join(slots, ["host", "group"]).drop("group").mapInArrow(induce, "host string, wrapper long").where("wrapper is not null")
    wrappers = induced.groupBy("host").agg(F.sort_array(F.collect_set("wrapper")).alias("wrappers"))
    return template.join(wrappers, "host", "full")


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``: the article's blocks, joined by two line feeds.

    Character references are decoded, white space in a block becomes one blank.
    Null, empty and text-less html gives an empty text. Pages without a host
    form one group. Repeated rows give repeated results; columns not named here
    are ignored. Where no wrapper is found on a page, or its host has none, the
    page's own mark of its article decides; without one, all but template and
    boilerplate stays.
    """
    ship(pages.sparkSession)
    pages = with_host_and_path(pages.select("page_id", "url", "html"))
    with scratch(pages.sparkSession):
        found = written(templates(pages, settings), keep=True)

    def run(batches):
        for batch in batches:
            template, wrappers = ([frozenset(t or ()) for t in batch.column(c).to_pylist()] for c in ("template", "wrappers"))
            texts = ["\n\n".join(dom.blocks(dom.parse(h or ""), t, w)) for h, t, w in zip(batch.column("html").to_pylist(), template, wrappers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(found, "host", "left").select("page_id", "url", "html", "template", "wrappers").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
