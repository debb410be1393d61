"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Method: every glob rule becomes a run of bits in a multiword Shift-And mask; one shift and one mask per byte
advance all rules at once, for a whole batch of URLs side by side. `*` is a state that keeps itself, `?` is one
code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Between host and path of a canonical URL: a byte that UTF-8 never holds.
SEPARATOR = 0xFF
STAR, ANY = "*", "?"
BATCH_ROWS = 65536


@dataclass(frozen=True)
class Rule:
    """verdict for the hosts that match `host` (globs allowed) and the paths that match `path`."""

    verdict: str
    host: str
    path: str
    name: str

    @staticmethod
    def site(verdict: str, host: str, path: str) -> Rule:
        """host with all its subdomains, and every path that starts with path; both taken literally."""
        return Rule(verdict, "*.\\" + "\\".join(host), "\\" + "\\".join(path) + STAR if path else STAR, host + path)


def rules_of(listed: DataFrame, most: int = 100_000) -> list[Rule]:
    """Rules of a table verdict, host, path, name, in the order of its column place; globs are allowed in host and path.

    The list goes to every task as masks, so a table of more than most rows is refused with ValueError. A null host or path
    stands for any, a null name for host and path.
    """
    rows = listed.orderBy("place").select("verdict", "host", "path", "name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(r.verdict, STAR if r.host is None else r.host, STAR if r.path is None else r.path, r.name or f"{r.host or STAR}{r.path or STAR}") for r in rows]


#: The listed rules of the query: host and its subdomains, path prefix.
SITE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Globs that judge what no listed rule fits; all else is allowed. Hosts here have a dot before them.
HOST_GLOBS = ["*casino*", "*free-bets*", "*cheap-pills*", "*ads-track*"]


def _symbols(glob: str) -> list[int | str]:
    """Bytes and wildcards of a glob; a backslash takes the next character literally."""
    out: list[int | str] = []
    literal = False
    for c in glob:
        if literal or c not in (STAR, ANY, "\\"):
            out += c.encode()
            literal = False
        elif c == "\\":
            literal = True
        else:
            out.append(c)
    return out


class Automaton:
    """All rules of a list as masks of 64-bit words."""

    def __init__(self, rules: list[Rule]):
        patterns = [[*_symbols(r.host), SEPARATOR, *_symbols(r.path)] for r in rules]
        bits = sum(sum(s != STAR for s in p) + 1 for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[int] = []
        at = 0
        set_bit = lambda masks, bit: np.bitwise_or(masks[..., bit // 64], np.uint64(1) << np.uint64(bit % 64), out=masks[..., bit // 64])
        inside = np.arange(256) != SEPARATOR  # no wildcard crosses from host to path
        tail = (np.arange(256) & 0xC0) == 0x80
        for pattern in patterns:
            set_bit(self.start, at)
            for s in pattern:
                if s == STAR:
                    rows = np.zeros((256, self.words), np.uint64)
                    set_bit(rows, at)
                    self.stay[inside] |= rows[inside]
                    continue
                at += 1
                rows = np.zeros((256, self.words), np.uint64)
                set_bit(rows, at)
                if s == ANY:
                    self.step[inside & ~tail] |= rows[inside & ~tail]
                    self.stay[tail] |= rows[tail]
                else:
                    self.step[s] |= rows[s]
            self.ends.append(at)
            at += 1

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which text fits which rule: a boolean of texts by rules."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        sizes = sizes[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        for t in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t come first
            byte, old = data[begins[:live] + t], state[:live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (old & self.stay[byte])
        out = np.zeros((n, len(self.ends)), bool)
        for i, bit in enumerate(self.ends):
            out[order, i] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: on to ? # or the end. Null, or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, sites: list[Rule], globs: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row.

    The longest of the sites rules that fit names rule and verdict (of equal lengths, the first listed); if none fits,
    rule is null and the first of globs that fits gives the verdict, else default. A null url, or one without ://, has
    an empty host and path. Every row of the table has its row in the result, repeated ids and null ids too; an empty
    table gives an empty result. Columns are taken by name, others are ignored.
    """
    rules = [*sites, *globs]
    by_length = sorted(range(len(sites)), key=lambda i: (-len(sites[i].name), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                fits = automaton.match([b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths, strict=True)])
                names: list[str | None] = [None] * len(hosts)
                verdicts = np.full(len(hosts), default, object)
                for i in range(len(globs) - 1, -1, -1):
                    verdicts[fits[:, len(sites) + i]] = globs[i].verdict
                for i in reversed(by_length):
                    for j in np.flatnonzero(fits[:, i]):
                        names[j], verdicts[j] = sites[i].name, sites[i].verdict
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[id_col, "host", "path", "rule", "verdict"]
                )

    host, path = host_and_path(F.col(url_col))
    ready = pages.select(F.col(id_col).cast("long").alias(id_col), host.alias("host"), path.alias("path"))
    return ready.mapInArrow(run, f"`{id_col}` long, host string, path string, rule string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), [Rule.site(*r) for r in SITE_RULES], [Rule("block", g, STAR, g) for g in HOST_GLOBS])


def _site_sql(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


_LONGEST = sorted(SITE_RULES, key=lambda r: -len(r[1] + r[2]))
OP8_SQL = f"""
with cut as (
  select page_id, case when url is not null and contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
)
select page_id, host, path,
  case {" ".join(f"when {_site_sql(h, p)} then '{h}{p}'" for _, h, p in _LONGEST)} else null end as rule,
  case {" ".join(f"when {_site_sql(h, p)} then '{v}'" for v, h, p in _LONGEST)}
    {" ".join(f"when host like '{g.replace('*', '%')}' then 'block'" for g in HOST_GLOBS)} else 'allow' end as verdict
from parts
"""
