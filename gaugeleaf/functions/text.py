"""Text as Column expressions: sentences, clauses, tokens, numbers, triplets, predicates, lexical entailment.

Word boundaries are spelt out, since those of Java and of other engines differ outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeleaf import config as c

EDGE = r"[^\p{L}\p{N}_]"
CUT = "\u0001"


def words_pattern(words: list[str]) -> str:
    """One of some words or phrases, in any case, as whole words."""
    return rf"(?i)(^|{EDGE})(?:{'|'.join(words)})({EDGE}|$)"


HEDGE, MARKER, DEICTIC, NESTED = (words_pattern(x) for x in (c.HEDGES, c.MARKERS, c.DEIXIS, c.NESTING))
LEADING, LEADING_SHORT = (rf"(?i)^(?:{'|'.join(p)})({EDGE}|$)" for p in (c.LEADING_PRONOUNS, c.PRONOUNS))
SPLIT_WORDS = words_pattern(["and", "but", "whereas"])
SUBJECT = r"[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*"
NUMBER = r"[-+]?[0-9][0-9,]*\.?[0-9]*"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas would compute it at every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space."""
    return _filled(F.split(F.regexp_replace(strip(text), r"([.!?])\s+", f"$1{CUT}"), CUT))


def clauses(sentence: Column) -> Column:
    """Cut at semicolons and at and, but, whereas; the whole sentence if nothing is left."""
    marked = F.replace(sentence, F.lit(";"), F.lit(CUT))
    for _ in range(2):  # neighbouring words share a boundary
        marked = F.regexp_replace(marked, SPLIT_WORDS, f"$1{CUT}$2")
    return _once(_filled(F.split(marked, CUT)), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(sentence))))


def words(text: Column) -> Column:
    """All lower-case words, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content(words: Column, stop: list[str] = c.STOP) -> Column:
    """The set of words without stop words."""
    return F.array_except(words, F.array(*map(F.lit, stop)))


def tokens(text: Column, stop: list[str] = c.STOP) -> Column:
    """The set of lower-case content tokens, in order of appearance."""
    return content(words(text), stop)


def coverage(a: Column, b: Column) -> Column:
    """Share of token set a that is in b; 0 if a is empty. Spark hashes the second set of an intersection: here a, mostly the smaller."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(b, a)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def negates(tokens: Column) -> Column:
    """Whether a token set has a negation."""
    return F.arrays_overlap(tokens, F.array(*map(F.lit, c.NEGATION)))


def entailment(premise: Column, hypothesis: Column, entail_tau: float = 0.5, contra_tau: float = 0.5, denies: Column | None = None) -> Column:
    """struct(label, raw) from token sets: C before E before N. denies: negates(premise), where it is known."""
    differ = (negates(premise) if denies is None else denies) != negates(hypothesis)
    label = lambda raw: F.when((raw >= contra_tau) & differ, "C").when(raw >= entail_tau, "E").otherwise("N")
    return _once(coverage(hypothesis, premise), lambda raw: F.struct(label(raw).alias("label"), raw.alias("raw")))


def first_number(text: Column) -> Column:
    """The first number times the magnitude that the text after it starts with; null without a number."""
    return F.when(text.rlike("[0-9]"), _scaled(F.regexp_extract(text, rf"(?s)^(.*?)({NUMBER})(.*)$", 2), F.regexp_extract(text, rf"(?s)^(.*?)({NUMBER})(.*)$", 3)))


def _scaled(number: Column, tail: Column) -> Column:
    factor = lambda low: F.when(low.startswith("k") | low.startswith("thousand"), 1e3).when(low.startswith("m"), 1e6).when(low.startswith("b"), 1e9).when(low.startswith("t"), 1e12).otherwise(1.0)
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * _once(F.lower(strip(tail)), factor)


def all_numbers(text: Column) -> Column:
    """Every number of a text, scaled, in order. A magnitude has eight letters at most, so no more of what follows a number is kept."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    follow = F.regexp_extract_all(text, F.lit(rf"(?s){NUMBER}(?=\s*(.{{0,8}}))"), F.lit(1))
    return F.filter(F.zip_with(found, follow, _scaled), lambda x: x.isNotNull())


def numeric_match(a: Column, b: Column, tolerance: float) -> Column:
    """Whether the first number of a is near any number of b."""
    x = first_number(a)
    return F.coalesce(F.exists(all_numbers(b), lambda y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))), F.lit(False))


def citation(text: Column) -> Column:
    """What stands in the first square brackets; null without any."""
    return F.nullif(F.regexp_extract(text, r"\[([^\]]+)\]", 1), F.lit(""))


def is_verifiable(text: Column) -> Column:
    return ~text.rlike(HEDGE)


def is_abstractive(text: Column) -> Column:
    return text.rlike(r"\[[^\]]*\s[^\]]*\]")


def has_leading_pronoun(text: Column) -> Column:
    return text.rlike(LEADING)


def is_indexical(text: Column) -> Column:
    return text.rlike(LEADING) | text.rlike(DEICTIC)


def has_discourse_marker(text: Column) -> Column:
    return text.rlike(MARKER)


def is_atomic(text: Column) -> Column:
    return ~(text.rlike(SPLIT_WORDS) | text.contains(";"))


def word_count(text: Column) -> Column:
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+")))


def by_place(text: Column) -> Column:
    """struct(subject, predicate, obj): the first word, the second, the rest; empty where there is none."""
    parts = F.split(strip(text), r"\s+")
    return F.struct(
        F.get(parts, F.lit(0)).alias("subject"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("predicate"),
        F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), " ").alias("obj"),
    )


def triplets(claim: Column) -> Column:
    """Array of structs, one for each clause; a clause with a nesting word is cut again at "and", semicolons and commas."""
    residual = lambda t: F.transform(_filled(F.split(t, r"(?i)\s+and\s+|;|,")), by_place)
    found = F.flatten(F.transform(clauses(claim), lambda t: F.when(t.rlike(NESTED), residual(t)).otherwise(F.filter(F.array(by_place(t)), lambda x: x["subject"] != ""))))
    whole = F.struct(claim.alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("obj"))
    return _once(found, lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(whole)))


def ask_hypothesis(question: Column) -> Column:
    """The question without its question marks and one leading interrogative; itself if nothing is left."""
    bare = strip(F.regexp_replace(strip(question), r"\?+$", ""))
    parts = F.split(bare, r"\s+")
    rest = F.when(F.lower(F.get(parts, F.lit(0))).isin(c.LEADING_ASK), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " ")).otherwise(F.array_join(parts, " "))
    return F.when(rest == "", question).otherwise(rest)


def last_subject(text: Column, end: int = 512) -> Column:
    """The last run of capitalised words; null without any.

    No run, with its edges, reaches past the start of a word in small letters, and what follows that start is cut into runs as in the
    whole text. So a long text is searched whole only if there is no run after the first such word of its end.
    """
    last = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(rf"(^|{EDGE})({SUBJECT})({EDGE}|$)"), F.lit(2)), F.lit(-1))
    rest = F.regexp_extract(F.right(text, F.lit(end)), rf"(?s)^.*?{EDGE}([a-z].*)$", 1)
    return F.coalesce(F.when(F.length(text) > end, last(rest)), last(text))


def resolve(text: Column, subject: Column) -> Column:
    """text with its leading pronoun replaced by subject, if there are both."""
    bare = strip(text)
    rest = F.regexp_replace(bare, rf"(?i)^(?:{'|'.join(c.PRONOUNS)})({EDGE}|$)", "$1")
    return F.when(subject.isNotNull() & bare.rlike(LEADING_SHORT), F.concat(subject, rest)).otherwise(bare)


def filler(text: Column) -> Column:
    """The first date, time or capitalised word that is no function word; null without any."""
    found = F.regexp_extract_all(text, F.lit(rf"(^|{EDGE})([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}:[0-9]{{2}}|[A-Z][a-zA-Z]+)"), F.lit(2))
    return F.get(F.filter(found, lambda x: ~x.isin(c.NOT_FILLER)), F.lit(0))


def short_hash(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def hash_bucket(key: Column, size: int = 100) -> Column:
    """SHA-256 of key, as a number, modulo size."""
    digits = F.transform(F.split(F.sha2(key.cast("binary"), 256), ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % size)


def seeded_bit(seed: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"), 256), 1, 2), 16, 10).cast("int") % 2 == 1


def slots(text: Column, seed: int = 20250730, dim: int = 64) -> Column:
    """The embedding's dimension of each content token, repeats included; one fixed dimension for a text without tokens."""
    return word_slots(words(text), seed, dim)


def word_slots(words: Column, seed: int = 20250730, dim: int = 64) -> Column:
    """slots() of words(): the first eight digits of MD5 modulo dim, of which the last two say all where dim divides 256."""
    at, n = (7, 2) if 256 % dim == 0 else (1, 8)
    kept = F.filter(words, lambda t: ~t.isin(c.STOP))
    found = F.transform(kept, lambda t: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), t).cast("binary")), at, n), 16, 10).cast("long") % dim).cast("int"))
    return _once(found, lambda v: F.when(F.size(v) == 0, F.array(F.lit(seed % dim))).otherwise(v))


def slot_counts(slots: Column, dim: int = 64) -> Column:
    """How often each dimension is among the slots. Up to 64 dimensions are letters of one text, in which Spark counts letters far faster than numbers of an array."""
    if dim > 64:
        return _once(slots, lambda v: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.size(v) - F.size(F.array_remove(v, d))).cast("double")))
    letters = F.array_join(F.transform(slots, lambda d: F.char(d + 48)), "")
    count = lambda s, d: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(chr(d + 48)), F.lit("")))).cast("double")
    return _once(letters, lambda s: F.array(*(count(s, d) for d in range(dim))))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def embedding(text: Column, seed: int = 20250730, dim: int = 64) -> Column:
    """Counts of hashed tokens scaled to length 1."""
    scaled = lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: x / n))
    return _once(slot_counts(slots(text, seed, dim), dim), scaled)


def slots_norm(slots: Column) -> Column:
    """The length of the count vector of slots."""
    return _once(slots, lambda v: F.sqrt(F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, d: a + F.pow((F.size(v) - F.size(F.array_remove(v, d))).cast("double"), 2))))


def slots_cosine(slots: Column, length: Column, counts: Column, counts_length: Column) -> Column:
    """The cosine of the count vector of `slots` and the vector `counts`, from the slots alone; to 9 places, so that ties are ties."""
    return F.round(F.aggregate(slots, F.lit(0.0), lambda a, d: a + F.get(counts, d)) / (length * counts_length), 9)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def contains_any(text: Column, needles) -> Column:
    """Case-insensitive substrings."""
    low, hit = F.lower(text), F.lit(False)
    for n in needles:
        hit = hit | low.contains(n.lower())
    return hit


def classify(question: Column, types: dict, default: str) -> Column:
    """The first type one of whose keywords is in the question."""
    out = None
    for name, (words, *_) in types.items():
        if words:
            out = F.when(contains_any(question, words), name) if out is None else out.when(contains_any(question, words), name)
    return out.otherwise(default)
