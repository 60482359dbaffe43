"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into 64-bit words, one bit for each symbol and one for each
rule's start. A step of the automaton shifts every word by one, ands the mask of the character
read, and keeps the bits that stand on a ``*``; so one pass over a URL simulates every rule. URLs
are stepped together as arrays, longest first, so that ended ones drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, glob) over host + path + query; ``*`` is any run of characters, ``?`` any one character.
DEFAULT_RULES = (
    ("spam_farm", "*spam-farm.*"),
    ("cheap_pills", "*cheap-pills.*"),
    ("casino", "*casino-win.*"),
    ("free_bets", "*free-bets.*"),
    ("ad_tracking", "ads-track.*"),
    ("ad_tracking_sub", "*.ads-track.*"),
    ("adult_path", "*/adult/*"),
    ("login_page", "*/login*"),
    ("search_page", "*/search?q=*"),
    ("cart", "*/cart/*"),
    ("feed", "*/feed.xml"),
    ("session_id", "*sessionid=*"),
    ("print_view", "*/print/*.html"),
    ("numbered_mirror", "mirror??.*"),
    ("deep_pager", "*page=????*"),
    ("binary_file", "*.exe"),
)

#: (pattern, replacement) in order; the same text serves Java's and RE2's engines.
_STEPS = (
    (r"^\s+|\s+$", ""),
    (r"#.*$", ""),
    (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
    (r"^[^/?]*@", ""),
)
_TAIL_STEPS = (
    (r"([?&])(utm_[^=&]*|gclid|fbclid|ref)(=[^&]*)?(&(utm_[^=&]*|gclid|fbclid|ref)(=[^&]*)?)*(&|$)", r"$1"),
    (r"[?&]+$", ""),
    (r"/+(\?|$)", "$1"),
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port or final dot, then path and query; no scheme,
    fragment, tracking parameters or final slash. Null stays null and blank text gives ''."""
    for pattern, to in _STEPS:
        url = F.regexp_replace(url, pattern, to)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^([^/?]*)", 1)), r"\.?(:(80|443)?)?$", "")
    tail = F.regexp_extract(url, r"(?s)^[^/?]*(.*)$", 1)
    for pattern, to in _TAIL_STEPS:
        tail = F.regexp_replace(tail, pattern, to)
    return F.concat(host, tail)


class Automaton:
    """The rules' masks: match[c] for each character class c, with class 0 for all other characters."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.names = [name for name, _ in rules]
        ends, symbols, loops, at = [], [], [], 0
        starts = []
        for _, glob in rules:
            starts.append(at)
            for c in glob:
                if c == "*":
                    loops.append(at)
                else:
                    at += 1
                    symbols.append((at, c))
            ends.append(at)
            at += 1
        self.words = max(1, (at + 63) // 64)
        chars = sorted({c for _, c in symbols if c != "?"})
        self.points = np.array([ord(c) for c in chars], np.uint32)
        self.match = np.zeros((len(chars) + 1, self.words), np.uint64)
        bit = lambda k: np.uint64(1 << (k % 64))
        for k, c in symbols:
            if c == "?":
                self.match[:, k // 64] |= bit(k)
            else:
                self.match[1 + chars.index(c), k // 64] |= bit(k)
        self.first, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for k in starts:
            self.first[k // 64] |= bit(k)
        for k in loops:
            self.loop[k // 64] |= bit(k)
        self.ends = np.array(ends, np.int64)

    def matches(self, urls: list[str]) -> np.ndarray:
        """urls x rules: whether the rule accepts the whole URL."""
        n = len(urls)
        state = np.repeat(self.first[None, :], n, 0)
        lens = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lens, kind="stable")
        points = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.points):
            near = np.searchsorted(self.points, points).clip(0, len(self.points) - 1)
            classes = np.where(self.points[near] == points, near + 1, 0)
        else:
            classes = np.zeros(len(points), np.int64)
        begin = (np.cumsum(lens) - lens)[order]
        state, falling = state[order], -lens[order]
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lens.max()) if n else 0):
            live = int(np.searchsorted(falling, -t, "left"))  # the URLs that are longer than t
            d = state[:live]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            state[:live] = (shifted & self.match[classes[begin[:live] + t]]) | (d & self.loop)
        out = np.empty((n, len(self.ends)), bool)
        out[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one
        return out


def filter_urls(pages: DataFrame, rules=DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, canonical_url, rules, blocked) for each row.

    rules holds the names of all rules that accept the canonical URL, sorted and joined by commas;
    blocked says whether there is one. A null URL gives null, '' and false; an empty one is matched as
    such. Repeated rows stay, URLs of any length are read whole, an empty table gives an empty one,
    and other columns are left out whatever their names.
    """
    rules = sorted((str(a), str(b)) for a, b in rules)
    auto = Automaton(rules)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            urls = [u or "" for u in col.to_pylist()]
            known = np.array(col.is_valid())
            hit = auto.matches(urls) & known[:, None]
            said: dict[bytes, str] = {}
            yield pa.array(
                [said.setdefault(row.tobytes(), "") or _name(said, row, auto.names) for row in hit], pa.string()
            )

    names = F.arrow_udf(run, "string")
    picked = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), canonical_url(F.col(url_col)).alias("canonical_url"))
    return picked.withColumn("rules", names("canonical_url")).withColumn("blocked", F.col("rules") != "")


def _name(said: dict[bytes, str], row: np.ndarray, names: list[str]) -> str:
    text = said[row.tobytes()] = ",".join(names[i] for i in np.flatnonzero(row))
    return text


def _sql(rules=DEFAULT_RULES) -> str:
    at = "url"
    for pattern, to in _STEPS:
        at = f"regexp_replace({at}, '{pattern}', '{to}', 'g')"
    tail = "regexp_extract(u, '(?s)^[^/?]*(.*)$', 1)"
    for pattern, to in _TAIL_STEPS:
        tail = f"regexp_replace({tail}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    host = r"regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '\.?(:(80|443)?)?$', '')"
    values = ", ".join(f"('{a}', '{b}')" for a, b in rules)
    return f"""
WITH s AS (SELECT page_id, url, {at} AS u FROM pages),
c AS (SELECT page_id, url, {host} || {tail} AS canonical_url FROM s),
r(name, rule) AS (VALUES {values}),
m AS (SELECT page_id, string_agg(DISTINCT name, ',' ORDER BY name) AS rules
      FROM c JOIN r ON canonical_url GLOB r.rule GROUP BY page_id)
SELECT page_id, url, canonical_url, coalesce(rules, '') AS rules, rules IS NOT NULL AS blocked
FROM c LEFT JOIN m USING (page_id)"""


ORACLE_SQL = _sql()
