"""URL filters: glob rules as one bit-parallel automaton over every canonical URL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices

#: Stands between host and path in canonical URLs and globs, as a symbol of its own beside the 256 bytes.
SEP = 256
#: Bytes of paths, and of automaton states (one for each URL), that a task holds at a time.
URL_BYTES, STATE_BYTES = 1 << 20, 1 << 20
#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Globs over ".host" and path, for URLs that no rule fits: `*` any run, `?` any one byte, `|` the border of host and path.
BLOCK_GLOBS = ("*.*casino*|*", "*.*free-bets*|*", "*.adult-*|*", "*.*-adult.*|*", "*.*spam-*|*", "*.*porn*|*", "*.*xxx*|*", "*.phish*|*", "*.malware*|*", "*|*.exe", "*|*/wp-login.php*")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; a null url or one without `://`: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Glob:
    symbols: tuple[int, ...]  # a byte, SEP, or -1 for any one byte
    gaps: frozenset[int]  # before these symbols (or after the last) stands a `*`

    @staticmethod
    def of(glob: str) -> Glob:
        symbols, gaps = [], set()
        for byte in glob.encode():
            if byte == ord("*"):
                gaps.add(len(symbols))
            else:
                symbols.append({ord("?"): -1, ord("|"): SEP}.get(byte, byte))
        return Glob(tuple(symbols), frozenset(gaps))

    @staticmethod
    def of_rule(rule: str) -> Glob:
        """A host and its subdomains, with paths that start with the rule's."""
        host, slash, path = rule.partition("/")
        symbols = [*f".{host}".encode(), SEP, *(slash + path).encode()]
        return Glob(tuple(symbols), frozenset({0, len(symbols)}))


class Automaton:
    """Shift-And over several 64-bit words: one bit for each symbol of each glob, all globs advanced at once.

    A bit is set while the glob up to its symbol matches the text read. Each byte shifts all bits by one, carried from
    word to word, and keeps those whose symbol is the byte; bits before a `*` also stay as they are.
    """

    def __init__(self, globs: list[Glob]):
        self.globs = globs
        n = sum(len(g.symbols) for g in globs)
        self.words = max(1, -(-n // 64))
        self.accepts = np.zeros((257, self.words), np.uint64)
        self.first, self.always, self.stay = (np.zeros(self.words, np.uint64) for _ in range(3))
        self.final: list[tuple[int, np.uint64] | None] = []
        at = 0
        for glob in globs:
            for i, symbol in enumerate(glob.symbols):
                word, bit = divmod(at + i, 64)
                mask = np.uint64(1 << bit)
                rows = slice(0, 256) if symbol == -1 else symbol
                self.accepts[rows, word] |= mask
                if i == 0:
                    self.first[word] |= mask
                    if 0 in glob.gaps:
                        self.always[word] |= mask
                if i + 1 in glob.gaps:
                    self.stay[word] |= mask
            at += len(glob.symbols)
            self.final.append((divmod(at - 1, 64)[0], np.uint64(1 << (at - 1) % 64)) if glob.symbols else None)

    def match(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts: symbols (0 to 256). A row for each text, a column for each glob: whether it matches the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        starts = (np.cumsum(lengths) - lengths)[order]
        state = np.zeros((len(texts), self.words), np.uint64)
        sizes = lengths[order]
        for step in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-sizes, -step, "left"))  # texts longer than step
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved = moved & ~self.first | (self.first if step == 0 else self.always)
            state[:n] = moved & self.accepts[flat[starts[:n] + step]] | now & self.stay
        out = np.zeros((len(texts), len(self.globs)), bool)
        for g, (glob, final) in enumerate(zip(self.globs, self.final)):
            out[order, g] = (sizes == 0) | bool(glob.gaps) if final is None else state[:, final[0]] & final[1] != 0
        return out


def canonical(host: str, path: str) -> np.ndarray:
    left, right = (np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for x in (f".{host}", path))
    return np.concatenate([left, [SEP], right])


def judge_urls(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, url: str = "url", id_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, glob for every row of pages, repeated rows and null ids included.

    Of the rules that fit, the longest gives rule and verdict (of equal ones, the first). Where none fits, rule is null
    and the verdict is block if one of the globs matches the canonical URL (glob: the first that does), else allow. Empty
    and null URLs have an empty host and path and are allowed unless a glob matches emptiness. Of a repeated rule the
    first counts. URLs may be of any length: a task works on URL_BYTES of them, and on STATE_BYTES of automaton states, at
    a time, or on one URL if that is more.
    """
    automaton = Automaton([*map(Glob.of_rule, (r for _, r in rules)), *map(Glob.of, block_globs)])
    longest = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))

    def judge(batches):
        for batch in slices(batches, 2, URL_BYTES, max(1, STATE_BYTES // (8 * automaton.words))):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hits = automaton.match([canonical(h, p) for h, p in zip(hosts, paths)])
            rule, verdict, glob = [], [], []
            for hit in hits:
                best = next((i for i in longest if hit[i]), None)
                own = next((g for g, x in zip(block_globs, hit[len(rules) :]) if x), None)
                rule.append(None if best is None else rules[best][1])
                verdict.append(rules[best][0] if best is not None else "block" if own else "allow")
                glob.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in (rule, verdict, glob))], names=[*batch.schema.names, "rule", "verdict", "glob"])

    given = F.col(url).cast("string")
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(host_of(given), F.lit("")).alias("host"), F.coalesce(path_of(given), F.lit("")).alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


ORACLE = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from h),
g as (select *, case
    when ('.' || host) like '%.%casino%' then '*.*casino*|*'
    when ('.' || host) like '%.%free-bets%' then '*.*free-bets*|*'
    when ('.' || host) like '%.adult-%' then '*.adult-*|*'
    when ('.' || host) like '%.%-adult.%' then '*.*-adult.*|*'
    when ('.' || host) like '%.%spam-%' then '*.*spam-*|*'
    when ('.' || host) like '%.%porn%' then '*.*porn*|*'
    when ('.' || host) like '%.%xxx%' then '*.*xxx*|*'
    when ('.' || host) like '%.phish%' then '*.phish*|*'
    when ('.' || host) like '%.malware%' then '*.malware*|*'
    when path like '%.exe' then '*|*.exe'
    when path like '%/wp-login.php%' then '*|*/wp-login.php*' end as "glob" from r)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when "glob" is not null then 'block' else 'allow' end as verdict, "glob" from g
"""
