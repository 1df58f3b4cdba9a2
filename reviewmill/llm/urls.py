"""URL filters: rules by host and path, and for other URLs the words their hosts are made of.

Host labels are names run together. A unigram model, counted over the visible texts, titles
and paths of all pages, splits each label into its likeliest words (Viterbi). A multinomial naive Bayes over the
words of host and path, learned from all URLs that a rule decides, judges the others.

Counts of words and tokens are tables without a cap. Runs of letters, hosts and paths meet them
once each in joins; the driver sees their totals only.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from reviewmill.llm.words import freeing
from reviewmill.operators.joins import BROADCAST_FILE_BYTES, lookup_join, stored_bytes
from reviewmill.session import cut_lineage

Rules = Sequence[tuple[str, str]]
COUNTED_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 16
_LETTERS = re.compile(r"[^\W\d_]+|\d+")
_TAG_END = r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*(?:>|\Z)"""
#: Comments, code and tags. An open one reaches to the end, as in browsers.
_UNSEEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template)(?=[\s/>]){_TAG_END}.*?(?:(?=</\1[\s/>])|\Z)|"
    rf"</?(?P<inline>a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)(?=[\s/>]){_TAG_END}|"
    rf"</?[a-z]{_TAG_END}|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)


def parse(pages: DataFrame, rules: Rules) -> DataFrame:
    """``pages`` (with ``url``) and ``host``, ``path`` and ``rule``: the longest rule that fits.

    A rule is a host and the start of a path; it fits its host and all subdomains. A null URL,
    or one without ``://``, has an empty host and path. Columns of these names are replaced.
    """
    found = F.instr("url", "://")
    rest = F.when(found > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    split = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    split = split.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    split = split.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0))
    host = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = split.withColumn("host", host)
    rule: Column = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    return split.withColumn("rule", rule).drop("_rest", "_host")


@dataclass
class UrlModel:
    """Word costs for splitting and counts of (allow, block) per token, of the words and tokens at
    hand; ``totals`` and ``distinct`` are those of all tokens, ``urls`` of all decided URLs."""

    costs: dict[str, float]
    unknown: float
    tokens: dict[str, tuple[int, int]]
    totals: tuple[int, int]
    urls: tuple[int, int]
    distinct: int = 0

    def split(self, name: str) -> list[str]:
        """The cheapest cut of a run of letters into words; letters in no word are cut singly and
        joined again with their neighbours of the same kind."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        lengths = sorted({1} | {len(word) for word in self.costs}, reverse=True)
        for end in range(1, len(name) + 1):
            for start in [end - n for n in lengths if n <= end]:
                cost = self.costs.get(name[start:end])
                if cost is None:
                    cost = self.unknown if end - start == 1 else None
                if cost is not None and best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        out: list[str] = []
        for word in reversed(words):
            single = word not in self.costs
            if single and out and out[-1].startswith("?"):
                out[-1] += word
            else:
                out.append("?" + word if single else word)
        return [w.removeprefix("?") for w in out]

    def prior(self) -> float:
        """Log odds of block against allow without any token."""
        return math.log((self.urls[1] + 1) / (self.urls[0] + 1))

    def evidence(self, found: Iterable[tuple[int, int, int]]) -> float:
        """What tokens add to the odds, given as (times, allow, block); their order is no matter."""
        size = self.distinct + 1
        return math.fsum(
            n * (math.log((block + 1) / (self.totals[1] + size)) - math.log((allow + 1) / (self.totals[0] + size)))
            for n, allow, block in found
        )


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ROWS_AT_ONCE."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS_AT_ONCE)):
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _exploded(rows: DataFrame, find: Callable[..., Iterable[tuple]], **columns: pa.DataType) -> DataFrame:
    """What ``find`` makes of each row of ``rows``, as rows of ``columns``."""
    schema = pa.schema(list(columns.items()))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches((x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in find(*row)), schema)

    return rows.mapInArrow(freeing(found), from_arrow_schema(schema))


def _small(table: DataFrame) -> bool:
    return stored_bytes(table) <= BROADCAST_FILE_BYTES


def visible_text(page: str) -> str:
    """Title and text of a page without tags, comments and code. Tags that flow with the text do
    not end a word, others do."""
    return html.unescape(_UNSEEN.sub(lambda tag: "" if tag["inline"] else " ", page))


def count_words(parsed: DataFrame, text: str = "html") -> DataFrame:
    """``word, n``: how often words of 2 letters or more stand in texts, titles and paths."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for page, path in zip(*batch.columns, strict=True):
                for source in (visible_text(page.as_py() or ""), path.as_py()):
                    counts.update(w for w in _LETTERS.findall(source.lower()) if 1 < len(w) and not w.isdigit())
                if len(counts) >= COUNTED_AT_ONCE:
                    yield from _batches(counts.items(), schema)
                    counts.clear()
        yield from _batches(counts.items(), schema)

    counted = parsed.select(F.col(f"`{text}`"), "path").mapInArrow(freeing(words), "word string, n long")
    return cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")), "url-words")


def split_runs(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``run, words`` for every run of letters in ``host``: its likeliest cut. Each run meets the
    counts of its own substrings."""
    total = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    unknown = math.log(total) + 2.0
    # one row per length that occurs: few, and only lengths up to a run's own are looked at
    lengths = [r["length"] for r in words.select(F.length("word").alias("length")).distinct().orderBy("length").collect()]

    def letters(host: str) -> Iterator[tuple[str]]:
        return ((run,) for run in _LETTERS.findall(host) if not run.isdigit())

    def substrings(key: str, run: str) -> Iterator[tuple[str, str]]:
        yield key, run
        for length in lengths:
            for start in range(len(run) - length + 1):
                yield key, run[start : start + length]

    def cut(run: str, found: list[dict]) -> Iterator[tuple[str, list[str]]]:
        costs = {f["word"]: math.log(total / f["n"]) for f in found}
        yield run, UrlModel(costs, unknown, {}, (0, 0), (0, 0)).split(run)

    runs = cut_lineage(_exploded(hosts.select("host"), letters, run=pa.string()).distinct().select(F.md5("run").alias("key"), "run"), "url-runs")
    parts = _exploded(runs, substrings, key=pa.string(), word=pa.string())
    known = lookup_join(parts, words, ["word"], "left", ["key"], small=_small(words))
    known = known.groupBy("key").agg(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("found"))
    known = runs.join(known, "key").select("run", "found")
    return cut_lineage(_exploded(known, cut, run=pa.string(), words=pa.list_(pa.string())), "url-cuts")


def _item(column: str) -> Column:
    """A host or path in the rows of its tokens, however long it is."""
    return F.concat(F.lit(column[0] + ":"), F.md5(column)).alias("item")


def url_tokens(hosts: DataFrame, paths: DataFrame, cuts: DataFrame) -> DataFrame:
    """``item, token, times, allow, block``: tokens of each host and each path, known by ``_item``,
    with the decided URLs that have it. They are the words of hosts and paths, and numbers by their
    length."""

    def of_host(item: str, host: str, allow: int, block: int) -> Iterator[tuple]:
        for run, n in Counter(_LETTERS.findall(host)).items():
            yield (item, None, f"#{len(run)}", n, allow, block) if run.isdigit() else (item, run, None, n, allow, block)

    def of_path(item: str, path: str, allow: int, block: int) -> Iterator[tuple]:
        found = Counter(f"p:#{len(w)}" if w.isdigit() else f"p:{w.lower()}" for w in _LETTERS.findall(path))
        return ((item, token, n, allow, block) for token, n in found.items())

    counts = {"times": pa.int64(), "allow": pa.int64(), "block": pa.int64()}
    in_hosts = _exploded(hosts.select(_item("host"), "*"), of_host, item=pa.string(), run=pa.string(), number=pa.string(), **counts)
    in_hosts = lookup_join(in_hosts, cuts, ["run"], "left", ["item"], small=_small(cuts))
    in_hosts = in_hosts.withColumn("word", F.explode(F.coalesce("words", F.array("number"))))
    in_hosts = in_hosts.withColumn("token", F.concat(F.lit("h:"), "word")).select("item", "token", *counts)
    in_paths = _exploded(paths.select(_item("path"), "*"), of_path, item=pa.string(), token=pa.string(), **counts)
    return cut_lineage(in_hosts.unionByName(in_paths), "url-tokens")


def judge_items(tokens: DataFrame, urls: tuple[int, int]) -> tuple[DataFrame, UrlModel]:
    """``item, odds`` (what its tokens add) of ``url_tokens``, and the totals of the model."""
    by_token = tokens.where("allow + block > 0").groupBy("token").agg(
        *[F.sum(F.col("times") * F.col(v)).alias(v) for v in ("allow", "block")]
    )
    by_token = cut_lineage(by_token, "url-token-counts")
    sums = by_token.agg(F.sum("allow").alias("a"), F.sum("block").alias("b"), F.count(F.lit(1)).alias("n")).first()
    model = UrlModel({}, 0.0, {}, (sums["a"] or 0, sums["b"] or 0), urls, sums["n"])

    def odds(item: str, found: list[dict]) -> Iterator[tuple[str, float]]:
        yield item, model.evidence((f["times"], f["allow"], f["block"]) for f in found)

    known = lookup_join(tokens.select("item", "token", "times"), by_token, ["token"], "inner", ["item"], small=_small(by_token))
    known = known.groupBy("item").agg(F.collect_list(F.struct("times", "allow", "block")).alias("found"))
    return cut_lineage(_exploded(known, odds, item=pa.string(), odds=pa.float64()), "url-odds"), model


def judge(pages: DataFrame, rules: Rules, text: str = "html") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_odds``: the rule's verdict, else the
    method's (block where the odds favour it, else allow; without any decided URL all are allowed).
    Rows are kept as they are, repeated ones too; columns of these names are replaced."""
    parsed = parse(pages, rules)
    verdicts = [(v, F.col("rule").isin([r for r, x in rules if x == v])) for v in ("allow", "block")]
    decided = [F.count(F.when(fits, 1)).alias(v) for v, fits in verdicts]
    hosts, paths = (cut_lineage(parsed.groupBy(c).agg(*decided), f"url-{c}s") for c in ("host", "path"))
    urls = hosts.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    cuts = split_runs(hosts, count_words(parsed, text))
    items, model = judge_items(url_tokens(hosts, paths, cuts), (urls["a"] or 0, urls["b"] or 0))

    kept = [c for c in parsed.columns if c not in (text, "verdict", "block_odds")]
    rows = parsed.select(*[F.col(f"`{c}`") for c in kept])
    total = F.lit(model.prior())
    for column in ("host", "path"):
        part = items.where(F.col("item").startswith(column[0] + ":")).select(F.col("item").alias("_item"), F.col("odds").alias(f"_{column}_odds"))
        rows = rows.withColumn("_item", _item(column))
        rows = lookup_join(rows, part, ["_item"], "left", ["url", F.spark_partition_id()], small=_small(items)).drop("_item")
        total = total + F.coalesce(f"_{column}_odds", F.lit(0.0))
    verdict = F.when(F.col("rule").isNull(), F.when(total > 0, "block").otherwise("allow"))
    for v, fits in verdicts:
        verdict = verdict.when(fits, v)
    return rows.select(*[F.col(f"`{c}`") for c in kept], verdict.alias("verdict"), total.alias("block_odds"))
