"""Settings and fixed tables of the evaluation engine. Values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: All thresholds, bands and seeds that results depend on.


@dataclass(frozen=True)
class Config:
    relevance_tau: float = 0.5
    entail_tau: float = 0.5
    contra_tau: float = 0.5
    band_green: float = 0.90
    band_amber: float = 0.75
    min_n: int = 10
    vital_weighting: bool = True
    dedupe_tau: float = 0.85
    double_nli: bool = True
    reference_mode: str = "generated"
    groundedness_k: int = 3
    numeric_tolerance: float = 0.0
    dag_rescue: bool = False
    precision_threshold: float = 0.5
    adequacy: float = 0.6
    corroboration_min: int = 2
    affiliation_rule: bool = True
    disinterest_sample_rate: float = 0.0
    as_of: str = "2026-07-31"
    method: str = "B"
    reverse_questions_n: int = 3
    off_ask_cap: float = 0.5
    lexical_min_overlap: float = 0.5
    anchor_alpha: float = 0.1
    centrality_min: int = 2
    max_hops: int = 3
    depth_decay: float = 0.5
    tree: bool = False
    edge_tau: float = 0.5
    topical_min: float = 0.3
    conformal_alpha: float = 0.05
    conformal_min_n: int = 6
    embedding_seed: int = 20250730
    embedding_dim: int = 64
    judge_seed: int = 1729
    entailment: str = "lexical"
    relevance: str = "lexical"
    resolver: str = "lexical"
    segmenter: str = "lexical"
    generator: str = "lexical"
    clause_parser: str = "lexical"
    coreference: str = "lexical"
    judge: str = "seeded"
    residual: str = "affirm"
    unanswerable: str = "deny"
    #: None: the fixed lists below.
    allowed: tuple[str, ...] | None = None
    denied: tuple[str, ...] | None = None
    coi_domains: tuple[str, ...] | None = None
    coi_authors: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for name in ("relevance_tau", "entail_tau", "contra_tau", "band_green", "band_amber", "dedupe_tau", "conformal_alpha", "anchor_alpha", "depth_decay"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for f in fields(self):
            value, default = getattr(self, f.name), f.default
            fits = isinstance(value, (int, float)) and not isinstance(value, bool) if type(default) is float else type(value) is type(default)
            if default is not None and not fits:
                raise ValueError(f"{f.name} must be {type(default).__name__}, not {type(value).__name__}")
        if self.method not in ("A", "B", "both"):
            raise ValueError(f"unknown method {self.method}")
        if self.reference_mode not in ("generated", "archetype", "templated"):
            raise ValueError(f"unknown reference_mode {self.reference_mode}")


def load(values: dict | None = None) -> Config:
    """Defaults with the given values in their place; an unknown name is an error."""
    known = {f.name for f in fields(Config)}
    if extra := set(values or {}) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return replace(Config(), **(values or {}))


def load_file(spark, path: str) -> Config:
    """Settings from a one-object JSON file on any store that Spark reads; it names them all, but for the lists that replace fixed ones."""
    row = spark.read.option("multiLine", True).json(path).first()
    values = row.asDict() if row else {}
    if missing := sorted(f.name for f in fields(Config) if f.default is not None and values.get(f.name) is None):
        raise ValueError(f"settings without a value: {missing}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    floats = {f.name for f in fields(Config) if type(f.default) is float}
    return load({k: float(v) if k in floats and isinstance(v, int) else v for k, v in values.items()})


#: Words and patterns.
STOP = "a an the of to in on for and or is are was were be been it its this that with as at by from into about over under how why what which who".split()
TERM_STOP = (
    "a an the of to in on for and or is are was were be been it its this that with as at by from into about how why what which who "
    "when where whom does did do can could should would will"
).split()
NEGATION = "not no never none cannot without fails fewer lower".split()
HEDGES = [*"maybe perhaps possibly probably likely arguably".split(), "i think", "i believe", "in my opinion", *"might may could should would seem seems appear appears hypothetically if".split()]
JUDGE_HEDGES = "maybe perhaps think believe arguably possibly might opinion feel seems probably likely guess suppose".split()
DECLINE = "cannot answer decline refuse unable insufficient information"
PRONOUNS = "he she it they this that these those".split()
LEADING_PRONOUNS = "he she it they this that these those him her them his its their".split()
DEIXIS = "here there now then today yesterday tomorrow currently recently".split()
NESTING = "that which who whom whose whether".split()
MARKERS = [
    "because", "since", "due to", "owing to", "as a result", "therefore", "thus", "hence", "consequently", "tied to", "linked to", "caused by",
    "lead to", "leads to", "result in", "results in", "resulting in", "driven by", "so that",
]
NOT_FILLER = "The A An It This That These Those They He She We You I In On At For And But Or".split()
LEADING_ASK = "what which who whom whose when where why how is are was were do does did can could should would will".split()
IMPOSSIBLE, REASONS = ("cannot", "can't", "impossible", "not possible", "unable to"), ("because", "due to", "since ")
MISSING_MARKS = ("fabricated", "nonexistent", "doesnotexist", "fake", "madeup")
ALLOWED = ("reuters.com", "bloomberg.com", "sec.gov", "ft.com", "wsj.com")
DENIED = ("fakenews.example", "contentfarm.example", "randomblog.example")
COI_DOMAINS, COI_AUTHORS = ("press.example", "ir.example"), ("Company Communications", "Investor Relations")

#: Question types, their keywords in order, and the requirements of each (id, text, vital).
REQUIREMENTS = {
    "drivers": (
        ["driver", "drivers", "decline", "decrease", "increase", "grew", "growth", "change", "why"],
        [("cost_drivers", "cost drivers behind the change", True), ("pricing", "pricing actions taken", True), ("one_time", "one-time or non-recurring items", False), ("fx", "foreign-exchange effects", False)],
    ),
    "comparison": (
        ["compare", "versus", "vs", "difference", "better", "worse"],
        [("side_a", "the first option's key points", True), ("side_b", "the second option's key points", True), ("bottom_line", "the bottom-line recommendation", True)],
    ),
    "default": ([], [("main_point", "the main point the question asks for", True), ("supporting", "supporting detail or evidence", False)]),
}
ARCHETYPES = {
    "comparison": (
        ["compare", "versus", "vs", "difference", "better", "worse", "or"],
        [("option_a", "the first option's key points", True), ("option_b", "the second option's key points", True), ("criteria", "the stated comparison criteria", True), ("verdict", "a comparative verdict", True)],
    ),
    "causal_explanation": (
        ["why", "cause", "causes", "driver", "drivers", "reason", "because", "led to", "due to"],
        [("outcome", "the outcome being explained", True), ("causes", "the causal factors behind it", True), ("mechanism", "how the causes produced the outcome", False)],
    ),
    "enumeration": (["list", "enumerate", "what are", "name the", "examples of"], [("items", "the items the question asks to enumerate", True), ("completeness", "coverage of all relevant items", True)]),
    "procedure": (["how do", "how to", "steps", "procedure", "process"], [("steps", "the ordered steps", True), ("prerequisites", "any prerequisites or inputs", False)]),
    "definition": (["what is", "define", "definition", "meaning of"], [("definition", "the core definition", True), ("distinction", "distinguishing features or examples", False)]),
    "recommendation": (["should", "recommend", "advise", "best", "worth"], [("recommendation", "the recommendation", True), ("rationale", "the rationale for it", True), ("tradeoffs", "key trade-offs or risks", False)]),
    "factual_lookup": (["who", "when", "where", "which", "how many", "how much"], [("answer", "the specific fact the question asks for", True), ("qualifier", "any qualifying context (date, unit, scope)", False)]),
    "default": ([], [("main_point", "the main point the question asks for", True), ("supporting", "supporting detail or evidence", False)]),
}
#: Task types, their keywords in order, and outcomes (id, text, verifier, weight, parameters).
TASKS = {
    "fix": (
        ["fix", "repair", "broken", "bug", "error", "doesn't work", "crash"],
        [
            ("corrected_artifact", "a corrected code block exists", "artifact_presence", 1.0, {"patterns": ["```", "def ", "return ", "class ", "= "]}),
            ("would_run", "the fix would run", "executable", 1.0, {"signals": ["def ", "return ", "import ", "```"], "run_claims": ["run", "runs", "works", "passes", "output", "compiles"]}),
            ("root_cause", "addresses the root cause", "adequacy", 1.0, {"cues": ["because", "cause", "root", "reason", "due"]}),
        ],
    ),
    "explain": (
        ["explain", "why", "how", "understand", "mechanism"],
        [
            ("mechanism", "explains the mechanism's key steps", "coverage", 1.0, {"requirement": "the mechanism and why it happens"}),
            ("responsive", "answers the specific ask", "import", 1.0, {"signal": "responsive"}),
            ("right_level", "pitched at the right level", "adequacy", 0.5, {"cues": ["example", "means", "simply", "in other words"]}),
        ],
    ),
    "compare": (
        ["compare", "versus", "vs", "difference", "better"],
        [
            ("both_sides", "covers both options", "coverage", 1.0, {"requirement": "both options with their trade-offs"}),
            ("bottom_line", "gives a bottom-line recommendation", "artifact_presence", 1.0, {"patterns": ["recommend", "overall", "choose", "better", "bottom line", "prefer"]}),
        ],
    ),
    "produce": (
        ["write", "create", "produce", "generate", "draft", "build"],
        [
            ("artifact_exists", "the requested artifact exists", "artifact_presence", 1.0, {"patterns": ["```", "def ", "- ", "| ", "1."]}),
            ("grounded", "the artifact does not invent facts", "import", 1.0, {"signal": "grounded"}),
        ],
    ),
    "summarize": (
        ["summarize", "summary", "tldr", "recap"],
        [
            ("key_points", "captures the key points", "coverage", 1.0, {"requirement": "the key points of the source"}),
            ("proportionate", "is proportionate in length", "constraint", 0.5, {"max_words": 120}),
            ("nothing_invented", "invents nothing", "import", 1.0, {"signal": "grounded"}),
        ],
    ),
    "recommend": (
        ["recommend", "advise", "suggestion", "should i", "best option"],
        [
            ("clear_rec", "makes a clear recommendation", "artifact_presence", 1.0, {"patterns": ["recommend", "should", "suggest", "i would", "go with"]}),
            ("justified", "the recommendation is justified", "import", 1.0, {"signal": "grounded"}),
            ("alternatives", "acknowledges alternatives", "artifact_presence", 0.5, {"patterns": ["alternative", "otherwise", "however", "option", "on the other hand"]}),
        ],
    ),
    "extract": (
        ["extract", "list", "pull out", "find all", "what are the"],
        [
            ("requested_values", "provides the requested values", "artifact_presence", 1.0, {"patterns": ["- ", "| ", "1.", ": "]}),
            ("correct_complete", "the values are correct and complete", "adequacy", 1.0, {"cues": ["all", "complete", "total", "each"]}),
        ],
    ),
}
TASK_DEFAULT = "explain"
RECALL_SAMPLE = (
    ("revenue decline", "cost drivers behind the change"),
    ("revenue decline", "foreign-exchange effects on revenue"),
    ("revenue decline", "the impact of a one-time legal settlement"),
)
