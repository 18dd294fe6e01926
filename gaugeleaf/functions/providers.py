"""Where scores come from: lexical columns by default, external models by Arrow batches on request.

A registry names for each kind of judgement a function from columns to a column. The default one has built-in expressions
only, so plans stay without Python. An external model registers a function that makes an Arrow UDF of the same shape; it
is loaded inside the batches, once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gaugeleaf import config as c
from gaugeleaf.config import Config
from gaugeleaf.functions import text as t

#: kind -> name -> function of columns.
_PROVIDERS: dict[str, dict[str, Callable[..., Column]]] = {
    "entailment": {"lexical": lambda premise, hypothesis: t.entailment(t.tokens(premise), t.tokens(hypothesis))},
    "relevance": {"lexical": lambda question, answer: t.jaccard(t.tokens(question), t.tokens(answer))},
    "embedding": {"lexical": t.embedding},
    "segmenter": {"lexical": t.sentences},
    "clauses": {"lexical": t.clauses},
    "coreference": {"lexical": t.resolve},
    "resolver": {"lexical": lambda reference: ~t.contains_any(reference, c.MISSING_MARKS)},
    "generator": {"lexical": lambda text, n: F.array_repeat(text, n)},
    "judge": {
        "affirm": lambda q, x: F.lit(True), "deny": lambda q, x: F.lit(False), "seeded": lambda q, x: t.seeded_bit(Config().judge_seed, q, x),
        "overlap": lambda q, x: t.coverage(t.tokens(q), t.tokens(x)) >= 0.5, "verifiable": lambda q, x: verifiable(x),
    },
    "consistency": {"lexical": lambda premise, conclusion: F.lit(True)},
}
_VERSIONS: dict[tuple[str, str], str] = {}


def verifiable(text: Column) -> Column:
    """Whether a text reads like a claim that can be checked: three content tokens, no hedge among them, no question."""
    found = t.tokens(text)
    return (F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: ~x.isin(c.STOP))) >= 3) & ~F.arrays_overlap(found, F.array(*map(F.lit, c.JUDGE_HEDGES))) & ~t.strip(text).endswith("?")


def overlap(tau: float) -> Callable[..., Column]:
    """A judge that says yes where the context covers a share of the question's content tokens."""
    return lambda q, x: t.coverage(t.tokens(q), t.tokens(x)) >= tau


def generated(tag: str, payload: Column, n: int = 1) -> Column:
    """What the built-in generator makes of a payload, as an array: its sentences, n repeats, its triplets spelt out, or itself."""
    if tag == "sentences":
        return t.sentences(payload)
    if tag == "repeat":
        return F.array_repeat(t.strip(payload), max(1, n))
    if tag == "triplets":
        parts = F.filter(F.transform(F.split(payload, r"(?i)\s+and\s+|;|,"), t.strip), lambda x: x != "")
        return F.transform(F.transform(parts, t.by_place), lambda p: F.concat_ws(" | ", p["subject"], p["predicate"], p["obj"]))
    return F.when(t.strip(payload) == "", F.array().cast("array<string>")).otherwise(F.array(t.strip(payload)))


def register(kind: str, name: str, make: Callable[..., Column], version: str = "1") -> None:
    if kind not in _PROVIDERS:
        raise KeyError(f"unknown kind {kind}")
    if name in _PROVIDERS[kind]:
        raise ValueError(f"{kind} provider {name} is registered")
    _PROVIDERS[kind][name] = make
    _VERSIONS[kind, name] = version


def stamp(kind: str, name: str = "lexical") -> tuple[str, str]:
    """Model and version that atoms carry of what decided them."""
    provider(kind, name)
    return f"{name}-{kind}", _VERSIONS.get((kind, name), "1")


def provider(kind: str, name: str = "lexical") -> Callable[..., Column]:
    if name not in _PROVIDERS.get(kind, {}):
        raise KeyError(f"unknown {kind} provider {name}")
    return _PROVIDERS[kind][name]


#: What a probe asks of each kind, as texts.
_PROBES = {
    "entailment": ("The bridge is open.", "bridge open"), "relevance": ("Is the bridge open?", "The bridge is open."), "embedding": ("bridge",), "segmenter": ("One. Two.",), "clauses": ("One and two.",),
    "coreference": ("It is open.", "bridge"), "resolver": ("https://a.example",), "generator": ("One. Two.", 2), "judge": ("Is it?", "It is."), "consistency": ("One.", "Two."),
}
#: The setting that names a kind's provider; kinds without one have their built-in provider.
SETTINGS = {"entailment": "entailment", "relevance": "relevance", "resolver": "resolver", "segmenter": "segmenter", "generator": "generator", "judge": "judge", "clauses": "clause_parser", "coreference": "coreference"}


def probe(spark: SparkSession, settings: Config = Config()) -> DataFrame:
    """kind, name, ok, error: whether each provider that the settings name is registered and answers; for before a run."""
    rows = []
    for kind, texts in _PROBES.items():
        name, error = getattr(settings, SETTINGS[kind]) if kind in SETTINGS else "lexical", None
        try:
            made = provider(kind, name)(*(F.lit(x) if isinstance(x, str) else x for x in texts))
            if spark.range(1).select(made.alias("x")).where("x is not null").isEmpty():
                error = "no answer"
        except Exception as e:  # of any model: what a probe is to find
            error = f"{type(e).__name__}: {e}".splitlines()[0][:300]
        rows.append((kind, name, error is None, error))
    return spark.createDataFrame(rows, "kind string, name string, ok boolean, error string")


def external_score(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scoring function of two texts from a model that load() makes on each worker, called on whole batches."""

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return lambda a, b: score(a, b)


def clean_prompt(prompt: Column) -> Column:
    """A prompt without its leading [[tag]] and with {{payload}} unwrapped."""
    return F.regexp_replace(F.regexp_replace(prompt, r"^\s*\[\[[^\]]+\]\]\s*", ""), r"(?s)\{\{(.*?)\}\}", "$1")
