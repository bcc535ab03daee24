"""Main-text extraction by a site style tree.

The DOMs of all pages of a host are merged: elements with the same path of tags and classes are one
node.  A node's presentations are the sequences of children it has on different pages, its contents the blocks of
text directly in it.  Over the m pages that have the node,

* presentation importance: entropy of the presentations, to the base m;
* content importance: 1 minus the mean, over the distinct blocks, of log_m(pages that have the block);
* importance: m + 0.1 presentation (1 - m), with m the mean of its parts, a part being a child node (its own importance) or
  a block (content importance), weighted by their average share among the node's children.  Never less than m, so that
  unique text does not lose importance with each element around it.

Containers of low importance are removed from each page of a host; as if ``PRIOR_PAGES`` more pages had shown a container
to be unique, so that few pages must agree more than many.  Removed too are elements that HTML's own meaning marks (navigation, footers, forms, hidden parts) or whose class or id names them as
adverts, notices, comments and the like; both have importance 0.  A branch that holds an article
or main element is never removed; where the tree alone would take most of an article or all text of a page, the
page keeps what its markup does not rule out.  Where a page has articles, the text is theirs; else that of its main element, else of
elements named as content, else of the whole body without blocks that are mostly links.

The counts are aggregated by Spark per (host, node, value) with map-side combination, so a host with a third
of all pages is no more than its distinct nodes and values; importances are computed from the deepest
up: level by level to ``LEVELS``, and below that, where each level has few nodes, per branch in one step.

Edge cases: null or empty html gives an empty text; a null or odd url belongs to the host of that string as far
as it goes; repeated rows are separate pages; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codedelta.llm import dom
from codedelta.llm.common import map_arrow, read_table, write_table

PRIOR_PAGES = 0.4
LOW_IMPORTANCE = 0.2
PRESENTATION = 0.1
#: Depths that are a level of their own; the nodes below a node of the last one are handled together.
LEVELS = 12
NODE, STYLE, BLOCK = 0, 1, 2
_COUNTS = "host string, kind int, node long, value long, depth int, container boolean, share double, text_share double, top long"


def host_of(url):
    """The host of a url in lower case, without user, port and a leading www."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def _counts(batches):
    """What a page adds to its host's tree: a row per node, presentation and block of text."""
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.int64()]
    for batch in batches:
        rows: list = []
        for host, source in zip(batch.column("host"), batch.column("html")):
            host = host.as_py()
            elements, blocks = dom.parse(source.as_py() or "")
            nodes: dict = {}
            styles = set()
            tops: dict = {}     # of a node below the levels, its ancestor of the last one
            for e in elements:
                if e.depth > LEVELS:
                    tops[e.key] = tops.get(e.parent.key, e.parent.key)
                size = len(e.children)
                text = e.children.count(0) / size if size else 0.0
                have = nodes.get(e.key)
                if have is None:
                    ruled_out = e.noise and not e.holds_main
                    nodes[e.key] = have = [e.parent.key if e.parent else 0, e.depth, e.tag in dom.CONTAINERS and not ruled_out, 0, 0.0, set()]
                have[3] += 1
                have[4] += text
                styles.add((e.key, dom.text_key(repr(e.children))))
            share: dict = {}
            for e in elements:
                for child in e.children:
                    if child:
                        share[child] = share.get(child, 0.0) + 1 / len(e.children)
            for key, (parent, depth, container, times, text, _) in nodes.items():
                # Shares are means over the places of the parent on the page.
                places = nodes[parent][3] if parent in nodes else 1
                rows.append((host, NODE, key, parent, depth, container, share.get(key, 0.0) / places, text / times, tops.get(key)))
            for key, style in styles:
                rows.append((host, STYLE, key, style, None, None, None, None, None))
            for key, value in {(b.element.key, dom.text_key(b.text)) for b in blocks}:
                rows.append((host, BLOCK, key, value, None, None, None, None, None))
            if len(rows) >= 50_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, kind, node, value, n, depth, container, share, text_share, top): the merged counts of all pages."""
    p = pages.select(host_of(F.col("url")).alias("host"), "html")
    return (map_arrow(p, _counts, _COUNTS).groupBy("host", "kind", "node", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.max("container").alias("container"),
                 F.sum("share").alias("share"), F.sum("text_share").alias("text_share"), F.max("top").alias("top")))


def _branch(table: pa.Table) -> pa.Table:
    """The importances of the nodes below one node of the last level."""
    t = table.to_pydict()
    parts: dict = {}
    values = [0.0] * table.num_rows
    for i in sorted(range(table.num_rows), key=lambda i: -t["depth"][i]):
        inner = (parts.get(t["node"][i], 0.0) + t["text_share"][i] * t["content"][i]) / t["pages"][i]
        values[i] = inner + PRESENTATION * t["presentation"][i] * (1 - inner)
        parts[t["parent"][i]] = parts.get(t["parent"][i], 0.0) + t["share"][i] * values[i]
    return table.select(["host", "node", "parent", "container", "pages", "share", "depth"]).append_column("importance", pa.array(values, pa.float64()))


def importances(counts: DataFrame) -> DataFrame:
    """(host, node, container, pages, importance) of all nodes, from the deepest level up."""
    per_node = counts.groupBy("host", "node")
    n = F.col("n").cast("double")
    nodes = per_node.agg(
        F.max(F.when(F.col("kind") == NODE, F.col("value"))).alias("parent"), F.max("depth").alias("depth"), F.max("container").alias("container"), F.max("top").alias("top"),
        F.sum(F.when(F.col("kind") == NODE, F.col("n"))).alias("pages"), F.sum("share").alias("share"), F.sum("text_share").alias("text_share"),
        F.sum(F.when(F.col("kind") == STYLE, n * F.log(n))).alias("style_log"), F.sum(F.when(F.col("kind") == STYLE, n)).alias("style_n"),
        F.sum(F.when(F.col("kind") == BLOCK, F.log(n))).alias("block_log"), F.count_if(F.col("kind") == BLOCK).alias("blocks"))
    log_m = F.log(F.col("pages").cast("double"))
    many = F.col("pages") > 1
    # One page may show a node in several presentations: the base is their number then.
    entropy = F.log(F.col("style_n")) - F.col("style_log") / F.col("style_n")
    nodes = nodes.select("host", "node", "parent", "depth", "top", "container", "pages", "share", "text_share",
                         F.when(many, F.least(entropy / log_m, F.lit(1.0))).otherwise(1.0).alias("presentation"),
                         F.when(F.col("blocks") == 0, 0.0).when(many, 1 - F.col("block_log") / (F.col("blocks") * log_m)).otherwise(1.0).alias("content"))
    nodes = write_table(nodes, "nodes")
    done = write_table(nodes.filter(F.col("depth") > LEVELS).groupBy("host", "top").applyInArrow(
        _branch, "host string, node long, parent long, container boolean, pages long, share double, depth int, importance double"), "branches")

    def parts_of(level):     # (host, parent, sum of share x importance)
        return level.groupBy("host", F.col("parent").alias("p")).agg(F.sum(F.col("share") * F.col("importance")).alias("parts")).withColumnRenamed("p", "node")
    below = parts_of(done.filter(F.col("depth") == LEVELS + 1))
    done = done.drop("depth")
    for depth in range(LEVELS, -1, -1):
        level = nodes.filter(F.col("depth") == depth).join(below, ["host", "node"], "left")
        inner = F.coalesce("parts", F.lit(0.0)) / F.col("pages") + F.col("text_share") / F.col("pages") * F.col("content")
        level = level.withColumn("importance", inner + PRESENTATION * F.col("presentation") * (1 - inner))
        level = write_table(level.select("host", "node", "parent", "container", "pages", "share", "importance"), f"level{depth}")
        below = parts_of(level)
        done = done.unionByName(level)
    return done.select("host", "node", "container", "pages", "importance")


def noise_nodes(pages: DataFrame, low: float = LOW_IMPORTANCE, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """(host, noise): the keys of the low-importance containers of each host, as many as its templates have."""
    imp = importances(write_table(tree_counts(pages), "counts"))
    shrunk = (F.col("pages") * F.col("importance") + prior_pages) / (F.col("pages") + prior_pages)
    low_ones = imp.filter(F.col("container") & (shrunk < low))
    return low_ones.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("noise"))


def main_text(source: str, noise=frozenset()) -> str:
    """The main text of a page, given the keys of the host's low-importance containers."""
    elements, blocks = dom.parse(source)
    ruled_out: dict = {}     # parents come first
    for e in elements:
        ruled_out[id(e)] = _marked(e) or (e.parent is not None and ruled_out[id(e.parent)])
    top = max((e.main for e in elements if e.main >= 2 and not ruled_out[id(e)]), default=0)
    named = not top and any(e.main == 1 and not ruled_out[id(e)] for e in elements)

    def picked(noise) -> list:
        state: dict = {id(elements[0]): (False, not top and not named)}
        for e in elements[1:]:     # parents come first
            out, inside = state[id(e.parent)]
            out = out or _marked(e) or (e.key in noise and not e.holds_main and e.main < 2)
            state[id(e)] = out, inside or (e.main == top if top else e.main == 1)
        found = [b for b in blocks if state[id(b.element)] == (False, True)]
        if not top and not named:
            found = [b for b in found if b.link_chars * 2 <= len(b.text)]
        return found

    chosen = picked(noise)
    if noise:
        plain = picked(frozenset())
        kept, all_of_it = (sum(len(b.text) for b in x) for x in (chosen, plain))
        # The tree does not take most of an article, nor all of a page.
        if kept * 2 < all_of_it and (top or not kept):
            chosen = plain
    return "\n".join(b.text for b in chosen)


def _marked(e) -> bool:
    """Noise by its tag, role, class or id; a class does not rule out an element that holds an article or main."""
    return bool(e.noise) and not (e.noise == 1 and e.holds_main)


def _extracted(batches):
    for batch in batches:
        texts = []
        for source, noise in zip(batch.column("html"), batch.column("noise")):
            texts.append(main_text(source.as_py() or "", frozenset(noise.as_py() or ())))
        rest = [batch.column(n) for n in ("page_id", "url")]
        yield pa.record_batch([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, low: float = LOW_IMPORTANCE, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    noise = write_table(noise_nodes(pages, low, prior_pages), "site_noise").withColumnRenamed("host", "h")
    p = pages.select("page_id", "url", "html")
    p = p.join(noise, host_of(F.col("url")) == F.col("h"), "left").select("page_id", "url", "html", "noise")
    return map_arrow(p, _extracted, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
