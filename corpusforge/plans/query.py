"""Query-side planning on the driver: tokens, boolean trees, limits and checks of one short string."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without search identity.
STOP_WORDS = set(
    "a an and are at build can create for generate graph happen happening how image in is make of on please show the this to video what whats with "
    "research goal find finding working work include including required requires custom nodes node checkpoint checkpoints model models loader loaders "
    "latent sampling setup setups frame frames generating generation needed using use used switch switching switches change changing convert converting "
    "making apply applying set setting add adding remove removing replace replacing workflow workflows comfy comfyui videos images audio".split()
)
#: Spellings that are searched together.
VARIANTS = {"ipadapter": ["ipadapter", "ip-adapter", "ip_adapter"], "ltx": ["ltx", "ltxv", "lightricks"], "hotshot": ["hotshot", "hotshotxl", "hot shot"], "wan2.1": ["wan2.1", "wan 2.1", "wan2_1"]}
SQL_TOKENS, RANK_TOKENS, MAX_ARMS, POOL = 4, 8, 12, 100
MAX_QUERY, MAX_FILTERS, MAX_IDS, MAX_LIMIT, MAX_CANDIDATES = 2000, 64, 256, 100, 500


def distinctive(query: str, most: int) -> list[str]:
    """Tokens with search identity; all that aren't numbers if none has."""
    raw = [t for t in re.findall(r"[a-zA-Z0-9][a-zA-Z0-9+._-]*", query) if not t.isdigit()]
    return ([t for t in raw if t.casefold() not in STOP_WORDS] or raw)[:most]


def variants(token: str) -> list[str]:
    return VARIANTS.get(token.casefold(), [token])


def like_arms(token: str, columns: list[str], most: int = MAX_ARMS) -> Column:
    """Any column contains any spelling without a blank, case aside; % and _ stand for themselves."""
    arms = [F.lower(F.col(c)).contains(v.lower()) for v in variants(token) if " " not in v for c in columns]
    return F.coalesce(reduce(lambda a, b: a | b, arms[:most]), F.lit(False))


@dataclass
class WebQuery:
    """`a b "c d" -e OR f` as a disjunction of conjunctions of terms, each a tuple of tokens (a phrase if longer than one)."""

    any_of: list[list[tuple[tuple[str, ...], bool]]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> WebQuery:
        groups: list = [[]]
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if word == "OR" and not minus:
                groups.append([])
                continue
            words = tuple(re.findall("[a-z0-9]+", (phrase or word).lower()))
            if words:
                groups[-1].append((words, bool(minus)))
        return cls([g for g in groups if g])

    def _test(self, term) -> Column:
        def both(group) -> Column:
            return reduce(lambda a, b: a & b, [~term(w) if no else term(w) for w, no in group])

        return F.coalesce(reduce(lambda a, b: a | b, map(both, self.any_of)), F.lit(False)) if self.any_of else F.lit(False)

    def matches(self, token_array: Column) -> Column:
        """Whether a token array satisfies the query; false for a query without terms."""
        line = F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))
        return self._test(lambda words: F.array_contains(token_array, words[0]) if len(words) == 1 else line.contains(" " + " ".join(words) + " "))

    def matches_lines(self, *lines: str) -> Column:
        """The same for columns that hold the tokens of successive fields with blanks between and around."""
        whole = F.concat(*[F.col(c) if i == 0 else F.substring(c, 2, 1 << 30) for i, c in enumerate(lines)])

        def term(words: tuple[str, ...]) -> Column:
            said = " " + " ".join(words) + " "
            return reduce(lambda a, b: a | b, [F.col(c).contains(said) for c in lines]) if len(words) == 1 else whole.contains(said)

        return self._test(term)

    def may_match(self, *fields: str) -> Column:
        """True wherever `matches_lines` is, by the words alone: a cheap test that goes before it. fields: in lower case."""
        said = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(w), F.lit(False)) for c in fields])
        groups = [reduce(lambda a, b: a & b, [said(w) for words, no in g if not no for w in words], F.lit(True)) for g in self.any_of]
        return reduce(lambda a, b: a | b, groups, F.lit(False))

    @property
    def positive(self) -> list[str]:
        return list(dict.fromkeys(t for g in self.any_of for words, no in g if not no for t in words))


def is_single_name(query: str) -> bool:
    q = query.strip()
    return bool(q) and not re.search(r'[\s"\-]', q)


def is_quoted(query: str) -> bool:
    q = query.strip()
    return len(q) > 2 and q[0] == q[-1] == '"'


def arms(query: str) -> list[str]:
    """Which arms a query runs."""
    return ["fts", *(["phrase"] if is_single_name(query) or is_quoted(query) else []), "identifier"]


@dataclass
class Filters:
    kinds: list[str] | None = None
    sources: list[str] | None = None
    item_ids: list[str] | None = None
    since: str | None = None
    channels: list[str] | None = None
    authors: list[str] | None = None

    def check(self) -> None:
        """Raises for lists that are too long, and for ids without exactly one kind."""
        for name in ("kinds", "sources", "channels", "authors"):
            if len(getattr(self, name) or []) > MAX_FILTERS:
                raise ValueError(f"more than {MAX_FILTERS} {name}")
        if self.item_ids is not None:
            if len(self.item_ids) > MAX_IDS:
                raise ValueError(f"more than {MAX_IDS} item_ids")
            if len({entity_of(k) for k in self.kinds or []}) != 1:
                raise ValueError("item_ids need exactly one entity type")

    def predicate(self) -> Column:
        """The filter over the columns of the feed."""
        tests = [F.lit(True)]
        if self.kinds:
            tests.append(F.col("kind").isin(self.kinds) | (F.col("entity_type").isin([k for k in self.kinds if k == "resource"] or [""])))
        for name, c in (("sources", "source"), ("item_ids", "item_id"), ("channels", "context"), ("authors", "author")):
            if values := getattr(self, name):
                tests.append(F.col(c).isin(values))
        if self.since:
            tests.append(F.col("created_at") >= F.lit(self.since).cast("timestamp_ntz"))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def entity_of(kind: str) -> str:
    return kind if kind in ("message", "distillation") else "resource"


def check_query(query: str, limit: int = 20) -> int:
    """The clamped limit; raises for an empty or over-long query."""
    if not query or not query.strip():
        raise ValueError("empty query")
    if len(query) > MAX_QUERY:
        raise ValueError(f"query of over {MAX_QUERY} characters")
    return max(1, min(MAX_LIMIT, limit))


def candidate_limit(limit: int) -> int:
    return min(5 * max(1, min(MAX_LIMIT, limit)), MAX_CANDIDATES)
