"""Full-text search: tokens, postings, boolean, phrase, within, ranked, spans, incremental index.

Postings are rows (doc_id, term, pos); nothing is gathered per term, so a frequent term is many
rows of a table, not one large value. A query is a set of alternatives for each required item. A scan
of the texts and a lookup in an index give the same rows: a null text never matches, a query without
items matches nothing, and a query of exclusions alone matches every other text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as textfn
from ..session import settled
from .store import Store

#: Characters of a word: letters of any script, or of ASCII alone.
WORD_CHARS, ASCII = r"[\p{L}']+", r"[a-z']+"
#: Limits of a query.
LEAST_WORD, MOST_SET_WORDS, MOST_WORDS = 2, 500, 1100
#: Units that `w/` names, by what stands between two of them.
UNITS = {"line": r"\n", "sent": r"(?<=[.?!])\s+", "para": r"\n\s*\n", "page": r"\f"}
# Words that a query leaves out unless told to keep them.
NOISE = frozenset("a about after again all also am an and any are as at be been but by can did do for from had has have he her him his i if in into is it its me my no not of on or our she so than that the their them then there these they this to too up us was we were what when where which who will with would you your".split())
STEM_LEAST = 3


class QueryError(ValueError):
    """The query breaks a limit, or asks for what an index can't tell."""


@dataclass(frozen=True)
class Words:
    """How texts and queries are cut into words. The pattern is one class of characters, repeated."""

    pattern: str = WORD_CHARS
    fold: bool = False  # without diacritics
    stem: bool = False

    def of(self, text: Column) -> Column:
        low = textfn.fold(text) if self.fold else F.lower(text)
        words = F.regexp_extract_all(low, F.lit(self.pattern), F.lit(0))
        return F.transform(words, lambda w: textfn.stem(w, STEM_LEAST)) if self.stem else words

    def split(self, text: str, wild: bool = False) -> list[str]:
        """The same for a query; with wild, `*` is part of a word and such words stay as they are."""
        low = text.lower()
        if self.fold:
            low = low.translate(textfn.folding())
        found = regex.findall(self.pattern.replace("[", "[*", 1) if wild else self.pattern, low)
        found = [w for w in found if w.strip("*")]
        return [w if "*" in w or not self.stem else textfn.stem_word(w, STEM_LEAST) for w in found]

    @property
    def chars(self) -> str:
        return self.pattern[1 : self.pattern.rindex("]")]


PLAIN = Words()


def tokens(text: Column, words: Words = PLAIN) -> Column:
    return words.of(text)


@dataclass
class Item:
    """One set of a query: any of its phrases, each a list of words, or a matcher of another kind:
    `regex`, `near` (value: percent and pattern) or `number`."""

    phrases: list[list[str]]
    negated: bool = False
    optional: bool = False
    kind: str = "words"
    value: str = ""


@dataclass
class Query:
    items: list[Item] = field(default_factory=list)
    least: int | None = None  # how many optional sets must hit
    within: int | str | None = None  # all sets in so many words, or in one unit
    words: Words = PLAIN

    @property
    def required(self) -> list[Item]:
        return [i for i in self.items if not i.negated and not i.optional]

    @property
    def open(self) -> bool:
        """Whether a text without any hit may match."""
        maybe = any(i.optional for i in self.items)
        return bool(self.items) and not self.required and not (maybe and self.least > 0)


def parse(text: str, synonyms: dict[str, list[str]] | None = None, keep_noise: bool = False, words: Words = PLAIN) -> Query:
    """`+w` must, `-w` must not, `~w` with synonyms, `(a,b)` any of, `"a b"` or `a-b` a phrase, `w*` words that
    begin so, `/re` a regular expression, `%80w` words about like w (90 without a number), `#>5` a number,
    `w/N` within N words, `w/line`, `w/sent`, `w/para` and `w/page` within one of these, `@N` at least N + 1 of the
    unmarked sets. Without `@`, all sets must hit.
    """
    out, marked = Query(words=words), []
    for sign, group, quoted, word in re.findall(r'([+\-~]?)(?:\(([^)]*)\)|"([^"]*)"|(\S+))', text):
        if m := re.fullmatch(r"w/(\d+|line|sent|para|page)", word or ""):
            out.within = int(m[1]) if m[1].isdigit() else m[1]
            continue
        if m := re.fullmatch(r"@(\d+)", word or ""):
            out.least = int(m[1]) + 1
            continue
        item = None
        if word and word[0] == "/" and len(word) > 1:
            textfn.translate_pattern(word[1:])
            item = Item([], kind="regex", value=word[1:])
        elif m := re.fullmatch(r"%(\d{1,2})?(.+)", word or ""):
            item = Item([], kind="near", value=f"{m[1] or 90} {m[2]}")
        elif word and word[0] == "#" and len(word) > 1:
            textfn.numeric_test(word[1:])
            item = Item([], kind="number", value=word[1:])
        if item is None:
            raw = group.split(",") if group else [quoted or word]
            phrases = [p for p in (words.split(r, wild=True) for r in raw) if p]
            if sign == "~":
                for phrase in list(phrases):
                    phrases += [words.split(s) for s in (synonyms or {}).get(" ".join(phrase), [])]
            if not keep_noise and not quoted:
                phrases = [p for p in phrases if len(p) > 1 or p[0] not in NOISE]
            if not phrases:
                continue
            if any(len(w.replace("*", "")) < LEAST_WORD for p in phrases for w in p):
                raise QueryError(f"a word has fewer than {LEAST_WORD} characters: {phrases}")
            if len(phrases) > MOST_SET_WORDS:
                raise QueryError(f"a set has more than {MOST_SET_WORDS} words")
            item = Item(phrases)
        item.negated = sign == "-"
        out.items.append(item)
        marked.append(sign == "+")
    if sum(len(i.phrases) for i in out.items) > MOST_WORDS:
        raise QueryError(f"the query has more than {MOST_WORDS} words")
    if isinstance(out.within, int) and any(i.kind != "words" for i in out.items if not i.negated):
        raise QueryError("only words stand within so many words")
    if out.least is not None:
        for item, must in zip(out.items, marked, strict=True):
            item.optional = not must and not item.negated
    return out


def postings(docs: DataFrame, key: str, text: str, words: Words = PLAIN, only: Query | None = None) -> DataFrame:
    """(key, pos, term) for each token, or for those alone that the words of a query can hit."""
    if only is None:
        return docs.select(key, F.posexplode(words.of(F.col(text))).alias("pos", "term"))
    plain = sorted({w for i in only.items for p in i.phrases for w in p if "*" not in w})
    wild = sorted({w for i in only.items for p in i.phrases for w in p if "*" in w})
    wanted = lambda t: reduce(lambda a, b: a | b, [t.isin(plain), *(t.rlike(_wild(w)) for w in wild)])
    placed = F.transform(words.of(F.col(text)), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return docs.select(key, F.explode(F.filter(placed, lambda x: wanted(x["term"]))).alias("x")).select(key, "x.pos", "x.term")


def _wild(word: str) -> str:
    return "^" + ".*".join(map(re.escape, word.split("*"))) + "$"


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words_sql(text: str, words: Words) -> str:
    low = f"lower({text})"
    if words.fold:
        low = f"translate({low}, {', '.join(map(quoted, textfn.folding_pair()))})"
    found = f"regexp_extract_all({low}, {quoted(words.pattern)}, 0)"
    return f"transform({found}, w -> regexp_replace(w, {quoted(textfn.stem_pattern(STEM_LEAST))}, '$1'))" if words.stem else found


def _spaced(words: str) -> str:
    return f"concat(' ', array_join({words}, ' '), ' ')"


def _hit(item: Item, text: str, spaced: str) -> str:
    if item.kind == "regex":
        return f"{text} RLIKE {quoted(textfn.translate_pattern(item.value))}"
    if item.kind == "near":
        percent, pattern = item.value.split(" ", 1)
        return f"approximate({text}, {quoted(pattern)}, {int(percent)}) IS NOT NULL"
    if item.kind == "number":
        return f"numeric_match({text}, {quoted(item.value)})"

    def one(phrase: list[str]) -> str:
        if any("*" in w for w in phrase):
            return f"{spaced} RLIKE " + quoted(" " + " ".join("[^ ]*".join(map(re.escape, w.split("*"))) for w in phrase) + " ")
        return f"contains({spaced}, {quoted(f' {" ".join(phrase)} ')})"

    return "(" + " OR ".join(map(one, item.phrases)) + ")"


def _wanted(query: Query, hit: Callable[[Item], str]) -> str:
    """Whether the sets that are not excluded hit as asked."""
    parts = [f"({hit(i)})" for i in query.required]
    if maybe := [f"CAST({hit(i)} AS INT)" for i in query.items if i.optional]:
        parts.append(f"({' + '.join(maybe)} >= {query.least})")
    return " AND ".join(parts) or "true"


def condition(text: str, query: Query) -> str:
    """SQL that tells whether a text, named or given as an expression, matches; no index needed.
    Separators between words of a phrase don't matter."""
    if not query.items:
        return "false"
    words = _words_sql(text, query.words)
    if isinstance(query.within, int):  # bound by a lambda, the words are taken from the text once
        near = _wanted(query, lambda i: _hit(i, text, "w"))
        windows = f"transform(sequence(1, greatest(size(ws), 1)), i -> {_spaced(f'slice(ws, i, {query.within})')})"
        cond = f"exists(array({words}), ws -> exists({windows}, w -> {near}))"
    elif query.within:
        if any(i.kind in ("near", "number") for i in query.items if not i.negated):
            raise QueryError("approximate words and numbers are not told by unit")
        near = _wanted(query, lambda i: _hit(i, "u", "w"))
        units = f"split({text}, {quoted(UNITS[query.within])})"
        cond = f"exists({units}, u -> exists(array({_spaced(_words_sql('u', query.words))}), w -> {near}))"
    else:
        cond = _wanted(query, lambda i: _hit(i, text, _spaced(words)))
    never = "".join(f" AND NOT ({_hit(i, text, _spaced(words))})" for i in query.items if i.negated)
    return f"coalesce({text} IS NOT NULL AND {cond}{never}, false)"


def match_scan(text: Column | str, query: Query) -> Column:
    """condition, of a column or a SQL expression."""
    if any(i.kind in ("near", "number") for i in query.items):
        textfn.register(SparkSession.active())
    if not isinstance(text, str):
        plain = re.fullmatch(r"Column<'([\w.]+)'>", str(text))
        if not plain:
            raise TypeError("give an expression as SQL")
        text = plain[1]
    return F.expr(condition(text, query))


def match_index(index: DataFrame, query: Query, key: str, keys: DataFrame | None = None, docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Keys of matching documents, from postings.

    Terms of the query are filtered at the scan; each set is then a set number, and one aggregate a
    document counts the sets. Words of a phrase are aligned by position first. A query that texts
    without any hit may match needs `keys`, the keys of all texts that are not null. What postings don't
    tell (expressions, approximate words, numbers, units) is looked up in `docs` for the keys that
    the words leave over.
    """
    if not query.items:
        return index.select(key).where(F.lit(False))
    rest = [i for i in query.items if i.kind != "words"]
    if rest or isinstance(query.within, str):
        if docs is None:
            raise QueryError("the index can't tell this; the texts are needed")
        told = [i for i in query.items if i.kind == "words" and not i.negated and not i.optional]
        if told:
            found = match_index(index, Query(told, words=query.words), key)
            docs = docs.join(found, key, "left_semi")
        return docs.where(match_scan(F.col(text), query)).select(key)
    if query.open and keys is None:
        raise QueryError("a query of exclusions needs the keys of all texts")
    spark = index.sparkSession
    rows = [(s, p, j, w, len(ph)) for s, i in enumerate(query.items) for p, ph in enumerate(i.phrases) for j, w in enumerate(ph)]
    plain = [r for r in rows if "*" not in r[3]]
    parts = []
    if plain:
        terms = spark.createDataFrame(plain, "s int, p int, j int, term string, size int")
        known = index.where(F.col("term").isin(sorted({r[3] for r in plain})))  # reaches the scan
        parts.append(known.join(F.broadcast(terms), "term").select(key, "pos", "s", "p", "j", "size"))  # at most 1100 rows are sent
    for s, p, j, w, size in (r for r in rows if "*" in r[3]):
        lit = [F.lit(x).alias(n) for n, x in (("s", s), ("p", p), ("j", j), ("size", size))]
        begins = F.col("term").startswith(w.split("*")[0])
        parts.append(index.where(begins & F.col("term").rlike(_wild(w))).select(key, "pos", *lit))
    hits = reduce(DataFrame.unionByName, parts)
    at = hits.select(key, "s", "p", "size", (F.col("pos") - F.col("j")).alias("at"))
    found = at.groupBy(key, "s", "p", "at", "size").agg(F.count("*").alias("n")).where("n = size").select(key, "s", "at", "size").distinct()
    number = {id(i): s for s, i in enumerate(query.items)}
    never = [s for s, i in enumerate(query.items) if i.negated]
    if isinstance(query.within, int):
        per = found.groupBy(key).agg(F.collect_list(F.struct("s", "at", (F.col("at") + F.col("size")).alias("end"))).alias("hits"))
        near = f"transform(filter(hits, x -> x.at >= h.at AND x.end <= h.at + {query.within}), x -> x.s)"
        cond = F.expr(f"exists(hits, h -> {_wanted(query, lambda i: f'array_contains({near}, {number[id(i)]})')})")
        sets = F.transform("hits", lambda x: x["s"])
    else:
        per = found.groupBy(key).agg(F.collect_set("s").alias("sets"))
        sets = F.col("sets")
        cond = F.expr(_wanted(query, lambda i: f"array_contains(sets, {number[id(i)]})"))
    if query.open:
        hit = per.where(F.arrays_overlap(sets, F.array(*[F.lit(s) for s in never]))) if never else per.limit(0)
        return keys.select(key).join(hit.select(key), key, "left_anti")
    if never:
        cond = cond & ~F.arrays_overlap(sets, F.array(*[F.lit(s) for s in never]))
    return per.where(cond).select(key)


def ranked(index: DataFrame, query: Query, key: str, k: int, weights: dict[str, float] | None = None, n_docs: DataFrame | None = None) -> DataFrame:
    """(key, score): k best documents by document frequency, term frequency, lead and proximity.

    score = sum over query terms of idf * (doc_freq + table_freq * ln(1 + tf) + lead / (1 + first)), plus
    proximity * (terms found - 1) / (1 + spread of their first positions). Ties by key. n_docs is one
    row with the column n_docs, how many texts have a word; it is counted from the index if not given,
    which then must hold all terms.
    """
    w = {"doc_freq": 1.0, "table_freq": 0.5, "lead": 0.5, "proximity": 1.0} | (weights or {})
    words = sorted({x for i in query.items if not i.negated for p in i.phrases for x in p})
    hits = index.where(F.col("term").isin(words))
    per = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    n = index.select(key).distinct().agg(F.count("*").alias("n_docs")) if n_docs is None else n_docs
    scored = per.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))  # a row for each query term; one row
    idf = F.log1p(F.col("n_docs") / F.col("df"))
    one = idf * (w["doc_freq"] + w["table_freq"] * F.log1p("tf") + w["lead"] / (1 + F.col("first")))
    total = scored.groupBy(key).agg(F.sum(one).alias("s"), F.count("*").alias("terms"), (F.max("first") - F.min("first")).alias("spread"))
    score = F.col("s") + w["proximity"] * (F.col("terms") - 1) / (1 + F.col("spread"))
    return total.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def spans(text: Column, query: Query) -> Column:
    """array<struct<set, start, length>> of hits in the lower-cased (or folded) text, in code points."""
    if query.words.stem or any(i.kind not in ("words", "regex") for i in query.items if not i.negated):
        raise QueryError("only words as they stand and expressions have spans")
    kind = "array<struct<set:int,start:int,length:int>>"
    low, chars = (textfn.fold(text) if query.words.fold else F.lower(text)), query.words.chars

    def of(s: int, item: Item) -> Column:
        if item.kind == "regex":
            pattern = textfn.translate_pattern(item.value)
        else:
            one = lambda w: f"[{chars}]*".join(map(re.escape, w.split("*")))
            pattern = "|".join(f"[^{chars}]+".join(map(one, p)) for p in sorted(item.phrases, key=len, reverse=True))
            pattern = f"(?<![{chars}])(?:{pattern})(?![{chars}])"
        parts = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), F.split(low, pattern, -1))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, x: Column) -> Column:
            start, size = a["at"] + F.length(x["1"]), F.length(x["0"])
            one = F.struct(F.lit(s).alias("set"), start.alias("start"), size.alias("length"))
            out = F.when(size.isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"])
            return F.struct(F.coalesce(start + size, a["at"]).alias("at"), out.alias("out"))

        return F.when(low.rlike(pattern), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast(kind))

    found = [of(s, item) for s, item in enumerate(query.items) if not item.negated]
    return F.array_sort(F.concat(*found), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["set"] - b["set"]))


def text_join(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, words: Words = PLAIN) -> DataFrame:
    """(query_key, key) where a document holds all words of a row's query."""
    terms = queries.select(query_key, F.explode(F.array_distinct(words.of(F.col(query_text)))).alias("term"))
    sizes = terms.groupBy(query_key).agg(F.count("*").alias("need"))
    index = postings(docs, key, text, words).select(key, "term").distinct()
    return index.join(terms, "term").groupBy(query_key, key).agg(F.count("*").alias("n")).join(sizes, query_key).where("n = need").select(query_key, key)


def closure(pairs: DataFrame, level: int = 2) -> DataFrame:
    """(term, equiv) of a thesaurus. Level 1 as given, 2 with the pairs reversed, 3 closed transitively."""
    base = pairs.select("term", "equiv").distinct()
    if level < 2:
        return base
    out = base.union(base.select(F.col("equiv").alias("term"), F.col("term").alias("equiv"))).where("term <> equiv").distinct()
    if level < 3:
        return out
    out = settled(out)
    size = out.count()
    while True:  # paths double with each round
        step = out.select("term", F.col("equiv").alias("mid")).join(out.select(F.col("term").alias("mid"), "equiv"), "mid").select("term", "equiv")
        out = settled(out.union(step).where("term <> equiv").distinct())
        if (now := out.count()) == size:
            return out
        size = now


def synonyms_of(pairs: DataFrame, terms: list[str], level: int = 1) -> dict[str, list[str]]:
    """What parse needs of a thesaurus (term, equiv): the equivalents of the terms of a query."""
    low = sorted({t.lower() for t in terms})
    rows = closure(pairs, level).where(F.lower("term").isin(low)).select(F.lower("term").alias("t"), "equiv").distinct().collect()
    return {t: sorted(r["equiv"] for r in rows if r["t"] == t) for t in low}


class TextIndex:
    """Postings in a folder: a base, clustered by term, and a part for each batch of new rows; beside
    them the keys of all texts. A small head names the current base, so an index can be opened again, and
    a batch that is added twice counts once."""

    def __init__(self, spark: SparkSession, folder: str, key: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Store(spark, self.folder)
        self.head = json.loads(self.store.read("head.json")) if self.store.exists("head.json") else None
        self.key = key or (self.head and self.head["key"])

    @property
    def words(self) -> Words:
        return Words(**self.head["words"])

    def _swap(self, head: dict) -> None:
        self.store.write("head.json", json.dumps(head))
        self.head = head

    def _path(self, part: str) -> str:
        return f"{self.folder}/{part}-{self.head['generation']}"

    def _write(self, generation: int, rows: DataFrame, keys: DataFrame) -> None:
        rows.repartitionByRange("term").sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{self.folder}/base-{generation}")
        keys.write.mode("overwrite").parquet(f"{self.folder}/keys-{generation}")

    def create(self, docs: DataFrame, text: str, words: Words = PLAIN) -> None:
        generation = self.head["generation"] + 1 if self.head else 0
        self._write(generation, postings(docs, self.key, text, words), docs.where(F.col(text).isNotNull()).select(self.key))
        self._swap({"generation": generation, "key": self.key, "text": text, "words": asdict(words), "batches": [], "merged": -1})

    def add(self, docs: DataFrame, batch: int | None = None) -> None:
        """Adds rows. A numbered batch that is already there, or merged, is replaced or left out; numbers rise."""
        if batch is not None and batch <= self.head["merged"]:
            return
        name = f"n{batch}" if batch is not None else f"u{len(self.head['batches'])}"
        text = self.head["text"]
        postings(docs, self.key, text, self.words).write.mode("overwrite").parquet(f"{self._path('delta')}/{name}")
        docs.where(F.col(text).isNotNull()).select(self.key).write.mode("overwrite").parquet(f"{self._path('new')}/{name}")
        if name not in self.head["batches"]:
            self._swap(self.head | {"batches": [*self.head["batches"], name]})

    def _read(self, base: str, delta: str) -> DataFrame:
        return self.spark.read.parquet(self._path(base), *(f"{self._path(delta)}/{b}" for b in self.head["batches"]))

    def new_rows(self) -> int:
        return self.spark.read.parquet(*(f"{self._path('new')}/{b}" for b in self.head["batches"])).count() if self.head["batches"] else 0

    def rows(self) -> DataFrame:
        return self._read("base", "delta")

    def keys(self) -> DataFrame:
        return self._read("keys", "new")

    def optimize(self, having_new_rows_over: int = 0) -> bool:
        """Merges new rows into the base if there are more than asked; base and parts swap together."""
        if self.new_rows() <= having_new_rows_over:
            return False
        generation = self.head["generation"] + 1
        self._write(generation, self.rows(), self.keys())
        numbers = [int(b[1:]) for b in self.head["batches"] if b[0] == "n"]
        self._swap(self.head | {"generation": generation, "batches": [], "merged": max([self.head["merged"], *numbers])})
        return True

    def search(self, query: str, synonyms: dict[str, list[str]] | None = None, docs: DataFrame | None = None) -> DataFrame:
        return match_index(self.rows(), parse(query, synonyms, words=self.words), self.key, self.keys(), docs, self.head["text"])
