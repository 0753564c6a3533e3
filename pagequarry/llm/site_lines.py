"""Lines repeated across one site's documents, by line templates.

A line is masked (lower case, digits deleted, white space collapsed) and goes down a token tree of fixed depth:
number of tokens, then its first `DEPTH` tokens (or, in a second tree, its last ones), where tokens that are not plain
letters take the wildcard branch. Trees grow in every task and are merged as sums: documents per leaf, and below a leaf
documents per place and token. In a leaf that covers enough documents of its site, a token stays where it covers
enough of them too; other places are wildcard slots. What is left of a line is its template. A template that
covers enough documents is repeated, and so are its lines:

* `repeated_lines`: templates without slots. They are whole masks, and their documents are counted exactly.
* `template_lines`: also templates with slots of which at least `MIN_FIXED` of the tokens and three with letters stay,
  so bylines and notices that differ by a name are found.

A mask on enough documents has no slot, as each of its tokens is on as many; so nothing is lost on the way.

Counts are partial sums before every shuffle, joins by leaf, mask or site are broadcast below a checked size and salted above it, and tokens are counted once per
mask and task, so a hot site or line costs no task more than its share. The tokens that stay in a leaf are few: at
most the site's lines per document divided by min_share in each place.

Defined results: null texts hold no lines and do not count as documents; a null or unparsable URL is no site and
its lines are never removed; repeated rows count once (by id); a line needs three runs of letters to be removed.
Clashing extra columns are harmless: only the named columns are read, and `without_repeated_lines` keeps all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

MIN_DOCS, MIN_SHARE, MIN_LETTER_RUNS = 5, 0.2, 3
DEPTH, SALTS = 2, 16
#: Rows (two numbers each) of a join's small side that every task may get.
MAX_BROADCAST_ROWS = 500_000
#: Share of its tokens that a template with slots must keep.
MIN_FIXED = 0.6
SLOT = "<*>"

_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")


def host_of(url: Column) -> Column:
    """Lower-cased host without scheme, user, port and leading www.; null where there is none."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def mask(line: str) -> str:
    return " ".join(_DIGITS.sub("", line.lower()).split())


def leaf_path(tokens: list[str], tail: bool = False) -> str:
    """The leaf of a masked line: token count, first (or last) tokens, wildcards for all but plain letters."""
    near = tokens[-DEPTH:] if tail else tokens[:DEPTH]
    return f"{len(tokens)} {'<' if tail else '>'} {' '.join(t if t.isalpha() else '*' for t in near)}"


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)


def parse_lines(pages: DataFrame) -> DataFrame:
    """For pages(id, host, text): id, site (hash), line_no, head, tail, mask (hashes of leaves and mask, salted by
    site), masked (text), first_of_head, first_of_tail, first_of_mask, letters.

    first_of_... marks the first line of its kind on its page; letters says whether the line may be removed at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for i, host, text in zip(batch["id"], batch["host"], batch["text"]):
                site, seen = _hash(host, 0), set()
                seed = site & 0xFFFFFFFFFFFFFFFF
                for k, line in enumerate(text.split("\n")):
                    runs = len(_LETTERS.findall(line))
                    if not runs or not (masked := mask(line)):
                        continue
                    tokens = masked.split(" ")
                    head, tail, own = _hash(leaf_path(tokens), seed), _hash(leaf_path(tokens, True), seed), _hash(masked, seed)
                    out.append((i, site, k, head, tail, own, masked, head not in seen, tail not in seen, own not in seen, runs >= MIN_LETTER_RUNS))
                    seen.update((head, tail, own))
            yield pd.DataFrame(out, columns=["id", "site", "line_no", "head", "tail", "mask", "masked", "first_of_head", "first_of_tail", "first_of_mask", "letters"])

    kind = pages.schema["id"].dataType.simpleString()
    schema = f"id {kind}, site long, line_no int, head long, tail long, mask long, masked string, first_of_head boolean, first_of_tail boolean, first_of_mask boolean, letters boolean"
    return pages.filter("host is not null and text is not null").mapInPandas(run, schema)


def hot_join(large: DataFrame, small: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """Join with the small side written and counted first. One of at most `MAX_BROADCAST_ROWS` rows goes to every task;
    with a larger one, the rows of a key of the large side are spread over `SALTS` parts by another column."""
    small = materialize(small, "site-side")
    if small.count() <= MAX_BROADCAST_ROWS:
        return large.join(F.broadcast(small), key, how)
    spread = large.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [key] if isinstance(key, str) else key
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")


def _thresholds(lines_of: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """site, needed: documents that a line must occur on."""
    sites = lines_of.filter("host is not null and text is not null").select("id", "host").distinct().groupBy("host").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # as integers: n_docs >= share * n
            yield pd.DataFrame({"site": [_hash(h, 0) for h in batch["host"]], "needed": [max(min_docs, int(np.ceil(n * min_share - 1e-9))) for n in batch["n"]]})

    return sites.mapInPandas(run, "site long, needed long")


def _located(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(text_col).alias("text"))


def _candidates(lines: DataFrame, needed: DataFrame, tree: str) -> DataFrame:
    """id, line_no, leaf, mask, masked, first_of_mask, letters, needed: lines of leaves that cover enough documents."""
    # an upper bound where rows are repeated, which keeps the filter sound
    leaves = lines.filter(f"first_of_{tree}").groupBy(F.col(tree).alias("leaf")).agg(F.count("*").alias("covered"), F.first("site").alias("site"))
    wide = hot_join(leaves, needed, "site", "leaf").filter("covered >= needed").select("leaf", "needed")
    rows = lines.select("id", "line_no", F.col(tree).alias("leaf"), "mask", "masked", "first_of_mask", "letters")
    return materialize(hot_join(rows, wide, "leaf", "id"), f"site-{tree}")


def _templates(candidates: DataFrame) -> DataFrame:
    """mask, leaf, needed, template, slots, fixed (tokens with letters that stay), tokens per mask of the candidates."""
    masks = candidates.filter("first_of_mask").groupBy("leaf", "mask", "needed").agg(F.count("*").alias("docs"), F.first("masked").alias("masked"))
    masks = materialize(masks, "site-masks")
    tokens = masks.select("leaf", "needed", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    often = tokens.groupBy("leaf", "needed", "place", "token").agg(F.sum("docs").alias("n")).filter("n >= needed")
    stay = often.groupBy("leaf").agg(F.collect_list(F.struct("place", "token")).alias("stay"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, kept = None, set()
        for batch in batches:
            out = []
            for own, at, need, masked, stay in zip(batch["mask"], batch["leaf"], batch["needed"], batch["masked"], batch["stay"]):
                if at != leaf:
                    leaf, kept = at, set() if stay is None else {(t["place"], t["token"]) for t in stay}
                tokens = masked.split(" ")
                filled = [t if (k, t) in kept else SLOT for k, t in enumerate(tokens)]
                out.append((own, at, need, " ".join(filled), filled.count(SLOT), sum(t != SLOT and _LETTERS.search(t) is not None for t in filled), len(tokens)))
            yield pd.DataFrame(out, columns=["mask", "leaf", "needed", "template", "slots", "fixed", "tokens"])

    # a leaf's tokens go with its rows: no bound in bytes, so no broadcast
    spread = masks.select("mask", "leaf", "needed", "masked").withColumn("__salt", F.pmod(F.xxhash64("mask"), F.lit(SALTS)).cast("int"))
    copies = stay.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, ["leaf", "__salt"], "left").drop("__salt").mapInPandas(fill, "mask long, leaf long, needed long, template string, slots int, fixed int, tokens int")


def repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """id, line_no of every line repeated on its site: templates without slots."""
    pages = _located(df, id_col, url_col, text_col)
    lines = materialize(parse_lines(pages), "site-lines")
    candidates = _candidates(lines, materialize(_thresholds(pages, min_docs, min_share), "site-thresholds"), "head")
    whole = _templates(candidates).filter("slots = 0").select("mask", "needed")
    held = materialize(hot_join(candidates.select("id", "line_no", "mask", "letters"), whole, "mask", "id"), "site-whole")
    masks = held.select("mask", "id", "needed").distinct().groupBy("mask", "needed").agg(F.count("*").alias("n_docs")).filter("n_docs >= needed").select("mask")
    return hot_join(held.filter("letters"), masks, "mask", "id", "left_semi").select("id", "line_no").distinct()


def template_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """id, line_no, template of every line whose template covers enough of its site's documents; where the two trees
    give a line two templates, that with fewer slots."""
    pages = _located(df, id_col, url_col, text_col)
    lines = materialize(parse_lines(pages), "site-lines")
    needed = materialize(_thresholds(pages, min_docs, min_share), "site-thresholds")
    found = None
    for tree in ("head", "tail"):
        candidates = _candidates(lines, needed, tree)
        kept = _templates(candidates).filter((F.col("slots") == 0) | ((F.col("fixed") >= MIN_LETTER_RUNS) & (F.col("tokens") - F.col("slots") >= MIN_FIXED * F.col("tokens"))))
        kept = kept.select("mask", "needed", "template", "slots", F.xxhash64("leaf", "template").alias("key"))
        held = materialize(hot_join(candidates.select("id", "line_no", "mask", "letters"), kept, "mask", "id"), f"site-{tree}-templates")
        wide = held.select("key", "id", "needed").distinct().groupBy("key", "needed").agg(F.count("*").alias("n_docs")).filter("n_docs >= needed").select("key")
        rows = hot_join(held.filter("letters"), wide, "key", "id", "left_semi").select("id", "line_no", "slots", "template")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("id", "line_no").agg(F.min(F.struct("slots", "template"))["template"].alias("template"))


def site_templates(df: DataFrame, id_col: str, url_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template, n_lines: the templates that cover enough of their site's documents; `<*>` marks a slot."""
    rows = template_lines(df, id_col, url_col, text_col, min_docs, min_share)
    hosts = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host")).filter("host is not null").distinct()
    return rows.join(hosts, "id").groupBy("host", "template").agg(F.count("*").alias("n_lines"))


def without_repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, out_col: str = "site_text", similar: bool = False, **thresholds) -> DataFrame:
    """df with out_col: the text without the lines repeated on its site (similar: nor those of templates with slots),
    all other columns and rows kept."""
    found = (template_lines if similar else repeated_lines)(df, id_col, url_col, text_col, **thresholds).groupBy("id").agg(F.collect_list("line_no").alias("__cut")).withColumnRenamed("id", "__id")
    joined = df.join(found, F.col(id_col) == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__cut", i)), "\n")
    return joined.withColumn(out_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(kept)).drop("__id", "__cut")
