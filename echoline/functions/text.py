"""Text functions as Columns: nothing here runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword classifier's words, the characters stripped from token edges, label aliases, emotion classes.
POSITIVE = (
    "amazing", "awesome", "beautiful", "best", "brilliant", "excellent", "fantastic", "goty", "great", "incredible", "love",
    "loved", "masterpiece", "perfect", "peak", "stunning", "wonderful",
)
NEGATIVE = (
    "awful", "bad", "boring", "broken", "bug", "bugged", "buggy", "crap", "disappointing", "garbage", "hate", "horrible",
    "refund", "terrible", "trash", "unplayable", "worst",
)
EDGES = ".,!?;:\"'()[]{}<>*_~`-—…"
ALIASES = {
    "label_0": "neg", "label_1": "neu", "label_2": "pos", "negative": "neg", "neutral": "neu", "positive": "pos",
    "neg": "neg", "neu": "neu", "pos": "pos",
}
EMOTIONS_POS = (
    "admiration", "amusement", "approval", "caring", "desire", "excitement", "gratitude", "joy", "love", "optimism", "pride", "relief",
)
EMOTIONS_NEG = (
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness",
)
MATCH, FALLBACK, STUB_VERSION = 0.75, 0.34, "stub/1"
CORPUS_LABELS = {
    "sst2": {"0": "neg", "1": "pos"}, "tweet_eval": {"0": "neg", "1": "neu", "2": "pos"}, "sentiment140": {"0": "neg", "2": "neu", "4": "pos"},
    "clapai": {"positive": "pos", "neutral": "neu", "negative": "neg"},
}
# Patterns of addresses and handles; characters that cost a token, or half of one; token budgets.
ADDRESS = r"(?iU)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
HANDLE = r"(?<![A-Za-z0-9_])@[A-Za-z0-9_]+"
WIDE_CHARS = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"
DENSE_CHARS = r"[\u0370-\u03ff\u0400-\u04ff]"
MAX_CHARS, MAX_TOKENS, LEAST_TOKENS, CUTS = 4000, 240.0, 16.0, 4

#: White space as str.isspace has it: Java's Unicode class and the four separators it lacks.
SPACE = r"[\s\x1c-\x1f]"
def normalise(text: Column) -> Column:
    """No-break spaces, URLs, handles and runs of white space reduced, in that order."""
    out = F.translate(text, "\u00a0", " ")
    out = F.regexp_replace(out, ADDRESS, "http")
    out = F.regexp_replace(out, HANDLE, "@user")
    return F.btrim(F.regexp_replace(out, f"(?U){SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words between white space, without edge punctuation; empty ones dropped."""
    return F.filter(F.transform(F.split(F.lower(text), f"(?U){SPACE}+"), lambda t: F.btrim(t, F.lit(EDGES))), lambda t: t != "")


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many tokens are in ``words``; repeats count."""
    return F.size(F.filter(tokens(text), lambda t: t.isin(*words))).cast("long")


def stub_sentiment(text: Column) -> Column:
    """struct(label, score): the class with more keyword hits, else a class picked by the text's SHA-256.

    One pass over the tokens: only the sign of positive less negative hits decides.
    """
    body = F.coalesce(text, F.lit(""))
    words = F.transform(F.split(F.lower(body), f"(?U){SPACE}+"), lambda t: F.btrim(t, F.lit(EDGES)))
    lean = F.aggregate(words, F.lit(0), lambda n, t: n + F.when(t.isin(*POSITIVE), 1).when(t.isin(*NEGATIVE), -1).otherwise(0))
    picked = F.conv(F.substring(F.sha2(body, 256), 1, 2), 16, 10).cast("int") % 3
    fallback = F.element_at(F.array(F.lit("pos"), F.lit("neu"), F.lit("neg")), picked + 1)
    blank = ~body.rlike(r"(?U)[^\s\x1c-\x1f]")
    told = lambda n: F.struct(
        F.when(n > 0, "pos").when(n < 0, "neg").when(blank, "neu").otherwise(fallback).alias("label"),
        F.when(n != 0, MATCH).otherwise(FALLBACK).alias("score"),
    )
    return F.transform(F.array(lean), told)[0]  # binds the sign, evaluated once


def author_hash(user: Column, salt: str) -> Column:
    """16 hex digits of a salted SHA-256; an empty user is an error, as is a missing salt."""
    if not salt:
        raise ValueError("a salt is needed")
    named = F.when(F.coalesce(user, F.lit("")) == "", F.raise_error(F.lit("empty user"))).otherwise(user)
    return F.substring(F.sha2(F.concat(named, F.lit(salt)), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    wide, dense = F.regexp_count(text, F.lit(WIDE_CHARS)), F.regexp_count(text, F.lit(DENSE_CHARS))
    return (wide + dense / 2.0 + (F.length(text) - wide - dense) / 4.0).cast("double")


def fit_to_tokens(text: Column, budget: float = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """The text, cut to ``max_chars`` and then before the character at which the estimate reaches the budget.

    Only the first ``4 * budget`` characters can matter, as each costs a quarter of a token at least.
    """
    short = F.substring(text, 1, max_chars)
    head = F.split(F.substring(short, 1, int(4 * budget) + 1), "")
    cost = lambda c: F.when(c.rlike(WIDE_CHARS), 4).when(c.rlike(DENSE_CHARS), 2).otherwise(1)  # noqa: E731  in quarters
    spent = F.aggregate(
        head, F.struct(F.lit(0).alias("kept"), F.lit(0).alias("spent")),
        lambda s, c: F.when(s["spent"] + cost(c) < int(4 * budget), F.struct((s["kept"] + 1).alias("kept"), (s["spent"] + cost(c)).alias("spent"))).otherwise(F.struct(s["kept"].alias("kept"), F.lit(int(4 * budget)).alias("spent"))),
    )
    return F.when(token_estimate(short) <= budget, short).otherwise(F.substring(short, F.lit(1), spent["kept"]))


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _mapped(values: dict[str, str], key: Column, what: str) -> Column:
    """The value of a key; any other key is an error, null stays null."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    return F.when(key.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"{what} has no label "), key))).otherwise(found)


def label_alias(raw: Column) -> Column:
    """pos, neu or neg for a model's label; any other label is an error."""
    return _mapped(ALIASES, F.lower(F.trim(raw)), "the alias table")


def corpus_label(corpus: str, raw: Column) -> Column:
    """pos, neu or neg for a public corpus's own label (sst2, tweet_eval, sentiment140, clapai)."""
    return _mapped(CORPUS_LABELS[corpus], F.lower(F.trim(raw.cast("string"))), corpus)


def emotion_class(emotions: Column) -> Column:
    """Any negative emotion wins, else any positive one, else neutral; names in any case."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    low = F.transform(emotions, F.lower)
    return F.when(F.arrays_overlap(low, names(EMOTIONS_NEG)), "neg").when(F.arrays_overlap(low, names(EMOTIONS_POS)), "pos").otherwise("neu")


def from_scores(scores: Column) -> Column:
    """struct(label, score) of three scores (neg, neu, pos): the first largest and its softmax; other lengths are an error."""
    checked = F.when(F.size(scores) == 3, scores).otherwise(F.raise_error(F.concat(F.lit("expected 3 class scores, got "), F.size(scores).cast("string"))))
    def told(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(v)))
        return F.struct(F.element_at(F.array(F.lit("neg"), F.lit("neu"), F.lit("pos")), F.array_position(v, F.array_max(v)).cast("int")).alias("label"), (1.0 / total).alias("score"))
    return F.transform(F.array(checked.cast("array<double>")), told)[0]


def sound(sentiment: Column) -> Column:
    """The sentiment struct, checked: a label of the three classes and a score within 0..1, else an error."""
    good = sentiment["label"].isin("pos", "neu", "neg") & sentiment["score"].between(0, 1)
    return F.when(F.coalesce(good, F.lit(False)), sentiment).otherwise(F.raise_error(F.concat(F.lit("not a sentiment: "), F.coalesce(F.to_json(sentiment), F.lit("null")))))


def apply_threshold(pos: Column, neu: Column, neg: Column, threshold: Column) -> Column:
    return F.when(neg >= threshold, "neg").when(pos > neu, "pos").otherwise("neu")


#: Function words that tell the languages apart, for the built-in detector; ties go to the first language.
STOP_WORDS = {
    "en": "the and of to is that with for was this in it on are not you have from at be they he she we my but so what".split(),
    "de": "der die und das ist nicht ein zu den mit von sich des auf für im dem auch es an als nach wie bei aber nur ich sie".split(),
    "fr": "le la les et des une est dans pour qui un du que ne pas sur au par plus avec ce il elle sont mais nous vous je".split(),
    "es": "el los las que una por con del para es y en un se no lo como más pero sus le ya o este sí porque muy la".split(),
    "it": "il di che è non gli della per sono con una del si ma anche come nel alla più questo lo le dei da".split(),
    "pt": "o os que não uma com para do da em um no na por mais as dos como mas ao ele das seu sua ou quando muito".split(),
    "nl": "de het een van en dat niet zijn op te met voor er maar om hij ook als dan aan bij nog naar heb ik je".split(),
}
SCRIPTS = {"ja": r"[\u3040-\u30ff]", "ko": r"[\uac00-\ud7af]", "zh": r"[\u4e00-\u9fff]", "ru": r"[\u0400-\u04ff]", "el": r"[\u0370-\u03ff]", "ar": r"[\u0600-\u06ff]", "he": r"[\u0590-\u05ff]"}
DETECT_CHARS = 1000


def detect_language(text: Column) -> Column:
    """A deterministic detector on the first 1000 characters, as the contract has it; null where nothing speaks.

    The script decides first, then the language with most function words; the words are split off once.
    """
    head = F.substring(text, 1, DETECT_CHARS)
    script = F.coalesce(*[F.when(head.rlike(v), k) for k, v in SCRIPTS.items()])

    def best(words: Column) -> Column:
        among = lambda v: lambda w: w.isin(*v)
        hits = F.array(*[F.size(F.filter(words, among(v))) for v in STOP_WORDS.values()])
        names = F.array(*[F.lit(k) for k in STOP_WORDS])
        return F.transform(F.array(hits), lambda h: F.when(F.array_max(h) > 0, F.element_at(names, F.array_position(h, F.array_max(h)).cast("int"))))[0]

    return F.coalesce(script, F.transform(F.array(F.split(F.lower(head), r"[^\p{L}]+")), best)[0])
