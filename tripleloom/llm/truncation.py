"""Texts whose end is missing: a hashed logistic regression trained on values that were cut on purpose.

1. Limits: lengths (in characters and in bytes) at which a source has far more different texts that do not end a line than
   at the lengths around (a format whose files are all of one length ends its lines).  Computed over all documents.
2. Marks: endings that texts at limits have far more often than random cuts of whole texts, as "..." is put by some
   sources where they cut.  They are found in the corpus; none is built in.
3. Training: from a bounded sample of texts that look intact (``SAMPLE_DOCUMENTS``, documented bound) positives are
   made by cutting at random bytes, and by cutting with the marks in the shares found; negatives are the texts themselves
   with and without their final newline.  Features are hashed: closing characters, shape of the last line, last word
   piece and whether the intact texts of the whole corpus know it (counted over all of them, without a cap), open brackets,
   quotes and comments of the whole text, length against the limit.
4. Every record is scored over its whole text.  Its length counts by how much more often cuts give such lengths than all
   texts have them, so very short texts are cut ones only where cuts make them that short.  How often a source truncates shifts its records' odds: the shares are
   estimated by expectation maximisation over a histogram of scores by source.  At a limit the odds are shifted by how many
   times more texts have that length than lengths around it.
5. All copies of a text that is cut off somewhere are cut off.

Defined cases: NULL and empty texts are not truncated; those of white space alone have the prior's odds, so they are not; a NULL source is a source of its own; a NULL or wrong language
is taken as one more language; repeated documents are each reported; without documents nothing is found; a corpus with few
intact texts is judged by a regression on these few, one without any by the prior, which reports nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, spread, stored

#: Intact texts that the classifier may be trained on.
SAMPLE_DOCUMENTS = 6_000
#: A word piece is known if at least so many intact texts have it.
KNOWN_TEXTS = 3
FEATURES = 1 << 15
#: Shares of examples in training: cut texts, and intact texts without a final newline.  The first is where the
#: estimation of each source's own share begins.
CUT_SHARE, BARE_SHARE = 0.04, 0.13
#: Share of intact texts that are as long as a limit by chance, in training; the limit's own evidence replaces it.
LIMIT_BY_CHANCE = 0.0002
#: A length is a limit of its source if so many times more texts have it than lengths around it.
LIMIT_RATIO, LIMIT_SPAN = 12.0, 64
BIN = 0.25
#: Weights before any example: texts are seldom cut, but often those with an open bracket and no end of line.
PRIOR = {"bias": float(np.log(CUT_SHARE / (1 - CUT_SHARE))), "open True -": 7.0}
#: A mark has at most so many characters, at least this share of the texts at limits (so there are few), and is so many
#: times as frequent as at random cuts.
MARK_CHARS, MARK_SHARE, MARK_RATIO = 12, 0.02, 20.0

_CODE = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)
_SCRIPT = re.compile(r'"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|\#[^\n]*', re.S)
_MARKUP = re.compile(r"<!--.*?-->", re.S)
_PIECE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")
_SHAPE = re.compile(r"[^\W\d_]+|\d+")
_SCRIPTS = {"python", "shell", "yaml", "ruby", "toml", "r", "perl"}


def _nothing(text: str) -> bool:
    """Whether a text holds nothing that could be cut: white space and byte order marks."""
    return not text.strip("\ufeff \t\r\n\f\v")


def _shape(text: str) -> str:
    return re.sub(r"\s+", " ", _SHAPE.sub(lambda m: "9" if m[0][0].isdigit() else "w", text))


def describe(text: str, lang: str | None, path: str | None, at_limit: bool, known: frozenset[str], marks: tuple[str, ...] = ()) -> list[str]:
    """Feature names of one text."""
    ext = (path or "").rpartition("/")[2].rpartition(".")[2].lower()[:6]
    lang = lang or f"?{ext}"
    end = "n" if text.endswith("\n") else "s" if text[-1:].isspace() else "-"
    body = text.rstrip()
    last = body.rpartition("\n")[2]
    bare = last.strip()
    kind = "script" if lang in _SCRIPTS else "markup" if lang in ("html", "xml") else "prose" if lang in ("markdown", "text") else "code"
    clean = (_SCRIPT if kind == "script" else _MARKUP if kind == "markup" else _CODE).sub(" ", text) if kind != "prose" else text
    curly, round_, square = (clean.count(a) - clean.count(b) for a, b in ("{}", "()", "[]"))
    tail = clean.rpartition("\n")[2]
    quote = '"' in tail or kind == "code" and "'" in tail
    comment = "/*" in clean if kind == "code" else "<!--" in clean if kind == "markup" else clean.count('"""') % 2 == 1
    fence = text.count("```") % 2 == 1 if kind == "prose" else False
    sign = lambda n: "+" if n > 0 else "-" if n < 0 else "0"
    balance = sign(curly) + sign(round_) + sign(square)
    mark = next((m for m in marks if text.endswith(m)), "")
    piece = _PIECE.search(text) if end == "-" else None
    word = piece[0].lower() if piece else ""
    seen = "none" if not piece else "known" if word in known else "new"
    first = re.match(r"\W{0,3}\w*", bare)[0][:12]
    closed = "c" if bare.endswith("*/") else "h" if bare.startswith(("#", "//", "--", "<!--")) else "l" if bare.startswith(("- ", "* ")) else "x"
    indent = "0" if last[:1] not in (" ", "\t") else "1"
    shape = _shape(bare)[-6:]
    limit = "L" if at_limit else "l"
    html = "" if kind != "markup" else str("<html" in text) + str("</html>" in text)
    out = [
        "bias", f"end {end}", f"lang {lang}", f"lang {lang} {end}", f"limit {limit}", f"limit {limit} {end}",
        f"last {lang} {body[-1:]} {end}", f"two {kind} {_shape(body[-2:])} {end}", f"shape {kind} {shape} {end}", f"shape {lang} {shape} {end}",
        f"balance {kind} {balance}", f"balance {lang} {balance} {end}", f"balance {lang} {balance} {closed}", f"balance {kind} {balance} {body[-1:]} {end}",
        f"curly {lang} {min(abs(curly), 4)} {closed}", f"round {kind} {min(max(round_, -2), 4)} {end}", f"quote {kind} {quote} {end}", f"quote {lang} {quote}", f"comment {kind} {comment}",
        f"fence {fence} {end}", f"open {'+' in balance} {end}", f"mark {bool(mark)} {end} {limit}", f"mark {mark} {end}",
        f"word {word} {kind}", f"seen {seen} {kind}", f"seen {seen} {lang}", f"piece {min(len(word), 8)} {seen}",
        f"first {lang} {first if len(first) < 9 else ''} {end}", f"closed {lang} {closed} {end}", f"indent {lang} {indent} {end}", f"indent {lang} {indent} {closed} {body[-1:]}",
        f"html {html}", f"sentence {kind} {body[-1:] in '.!?:;'} {end} {closed}",
    ]
    if not bare:
        out.append("nothing")
    return out


def _hash(names: list[str]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(n.encode()) % FEATURES for n in names), np.int32, len(names)))


# -- limits ------------------------------------------------------------------------------------------------------


def limits(documents: DataFrame) -> DataFrame:
    """(source, unit, size, texts, ratio): lengths that are limits of their source; unit is ``chars`` or ``bytes``.

    A limit shows by texts that do not end a line; ``ratio`` says how many times more texts, of any end, have the length
    than a length around it, times the share of those that reach the length and do not exceed it.
    """
    ended = F.col("text").endswith("\n") | F.col("text").endswith("\r")
    texts = documents.where("text <> ''").select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("mark"), ended.alias("ended"))
    each = texts.distinct().select("source", "ended", F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))))
    counts = each.groupBy("source", "unit", "size").agg(F.count("*").alias("texts"), F.count_if(~F.col("ended")).alias("open_"))
    around = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-LIMIT_SPAN, LIMIT_SPAN)
    reach = F.sum("texts").over(Window.partitionBy("source", "unit").orderBy("size").rowsBetween(0, Window.unboundedFollowing))
    stop = F.col("texts") / reach
    times = lambda c: stop * F.col(c) / F.greatest((F.sum(c).over(around) - F.col(c)) / (2 * LIMIT_SPAN), F.lit(0.25))
    return counts.withColumns({"ratio": times("texts"), "odd": times("open_")}).where(F.col("odd") >= LIMIT_RATIO).select("source", "unit", "size", "texts", "ratio")


def with_limits(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Non-empty documents with ``at_limit``: whether their length is a limit of their source, and the limit's ratio."""
    ratios = lambda unit: F.map_from_entries(F.collect_list(F.when(F.col("unit") == unit, F.struct("size", "ratio")))).alias(unit)
    by_source = found.groupBy("source").agg(ratios("chars"), ratios("bytes"))
    rows = spread(documents.where("text <> ''").select("doc_id", "text", "lang", "path", "source")).select("doc_id", "text", "lang", "path", F.coalesce("source", F.lit("")).alias("source"))
    ratio: Column = F.greatest(F.try_element_at("chars", F.length("text")), F.try_element_at("bytes", F.octet_length("text")))
    return rows.join(broadcast_if_small(by_source), "source", "left").select("doc_id", "source", "text", "lang", "path", ratio.alias("ratio")).withColumn("at_limit", F.col("ratio").isNotNull())


# -- training ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    known: frozenset[str]
    marks: tuple[str, ...] = ()
    #: How many of the examples that were cut have a length of so many bits.
    cut_sizes: dict[int, int] = field(default_factory=dict)


def size_bits(size: Column) -> Column:
    return F.length(F.bin(size.cast("bigint")))


def marks_found(marked: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Marks of cuts and their shares among the texts at limits; longest first.

    Endings that at least ``MARK_SHARE`` of the texts at limits have reach the driver (at most ``MARK_CHARS`` / share),
    and eight random cuts of each text of the bounded ``sample``.
    """
    ends = marked.where("at_limit").select(F.right("text", F.lit(MARK_CHARS)).alias("end"), F.xxhash64("text").alias("text")).distinct()
    ends = stored(ends.select("end"), "ends")
    there = ends.count()
    if not there:
        return {}
    each = ends.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("end")), lambda k: F.right("end", k))).alias("end"))
    counts = {r.end: r.n for r in each.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, MARK_SHARE * there)).collect()}
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (1 + F.pmod(F.xxhash64("doc_id", k), F.length("text"))).cast("int"))).alias("at")
    cuts = [r.end for r in sample.select("text", at).select(F.right(F.left("text", F.col("at")), F.lit(MARK_CHARS)).alias("end")).collect()]
    usual = Counter(c[-k:] for c in cuts for k in range(1, len(c) + 1))
    odd = {e: n for e, n in counts.items() if n / there >= MARK_RATIO * (usual[e] + 1) / (len(cuts) + 1)}
    # of endings of one another those that stand for themselves
    own = {
        e: n for e, n in odd.items()
        if not any(e != o and e.endswith(o) and m > 1.5 * n for o, m in odd.items()) and not any(e != o and o.endswith(e) and m >= 0.8 * n for o, m in odd.items())
    }
    return {e: own[e] / there for e in sorted(own, key=lambda e: (-len(e), e))}


def _examples(marks: dict[str, float]):
    choices, shares = ["", *marks], [max(0.0, 1 - sum(marks.values())), *marks.values()]
    shares = np.array(shares) / sum(shares)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, lang, path in zip(b["doc_id"], b["text"], b["lang"], b["path"]):
                rng = np.random.default_rng(doc & 0x7FFFFFFFFFFFFFFF)
                data = text.encode()

                def add(t: str, limit: bool, label: int, weight: float) -> None:
                    if t:
                        rows.append((doc % 10, t, lang, path, limit, label, weight, last_piece(t)))  # noqa: B023

                bare = text[:-1]
                add(text, False, 0, 1 - BARE_SHARE)
                add(bare[:-1] if bare.endswith("\r") else bare, False, 0, BARE_SHARE)
                add(text, True, 0, LIMIT_BY_CHANCE)
                for _ in range(3):
                    if len(data) > 2:
                        cut = data[: rng.integers(max(1, len(data) // 10), len(data) - 1)].decode("utf-8", "replace" if rng.random() < 0.7 else "ignore")
                        if rng.random() < 0.1 and not cut.endswith("\ufffd"):
                            cut += "\ufffd"  # the cut went through a character
                        if text[len(cut) :].strip():
                            add(cut, False, 1, CUT_SHARE / 3)
                for _ in range(2):
                    if len(text) > 2:
                        n = int(rng.integers(len(text) // 4, max(len(text) - 8, len(text) // 4 + 1)))
                        mark = choices[rng.choice(len(choices), p=shares)]
                        add(text[: max(n - len(mark), 0)] + mark, True, 1, CUT_SHARE / 2)
            yield pd.DataFrame(rows, columns=["fold", "shown", "lang", "path", "at_limit", "label", "weight", "word"])

    return run


def _described(known: frozenset[str], marks: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            features = [_hash(describe(t, lang, path, limit, known, marks)) for t, lang, path, limit in zip(b["shown"], b["lang"], b["path"], b["at_limit"])]
            yield b[["fold", "label", "weight"]].assign(features=features)[["fold", "features", "label", "weight"]]

    return run


def fit(features: list[np.ndarray], label: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 2e-6) -> np.ndarray:
    """Weights of a weighted logistic regression over sets of hashed features, by full-batch Adam.

    The ridge draws to the prior's weights, from which the descent also begins: without examples they are the result.
    """
    prior = np.zeros(FEATURES)
    for name, value in PRIOR.items():
        prior[_hash([name])] = value
    if not features:
        return prior
    size = np.fromiter(map(len, features), np.int64, len(features))
    columns, starts = np.concatenate(features), np.concatenate([[0], np.cumsum(size)])[:-1]
    row = np.repeat(np.arange(len(features)), size)
    w, m, v = prior.copy(), np.zeros(FEATURES), np.zeros(FEATURES)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.add.reduceat(w[columns], starts)
        gap = weight * (1 / (1 + np.exp(-z)) - label)
        g = np.bincount(columns, gap[row], FEATURES) + ridge * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.08 * (1 - step / (steps + 50)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def intact_texts(marked: DataFrame) -> DataFrame:
    """Texts that look intact: they end with a newline and are not at a limit."""
    return marked.where(~F.col("at_limit") & F.endswith("text", F.lit("\n")))


def intact_sample(marked: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """At most about ``most`` of the texts that look intact."""
    intact = intact_texts(marked)
    there = intact.count()
    if there > most:
        intact = intact.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / there))
    return intact


def known_pieces(marked: DataFrame) -> DataFrame:
    """(piece): the word pieces that at least ``KNOWN_TEXTS`` of all intact texts have; one aggregate, combined map-side."""
    pieces = intact_texts(marked).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z]?[a-z]+|[A-Z]+)(?![a-z])"), 1))).alias("piece"))
    counted = pieces.groupBy(F.lower("piece").alias("piece")).agg(F.count("*").alias("n"))
    return stored(counted.where(F.col("n") >= KNOWN_TEXTS).select("piece"), "pieces")


def last_piece(text: str) -> str:
    piece = _PIECE.search(text)
    return piece[0].lower() if piece else ""


def train(marked: DataFrame, most: int = SAMPLE_DOCUMENTS, pieces: DataFrame | None = None) -> Model:
    """Only those of the known ``pieces`` that end an example reach the driver: a few for each text of the sample."""
    pieces = known_pieces(marked) if pieces is None else pieces
    sample = stored(intact_sample(marked, most).select("doc_id", "text", "lang", "path"), "sample")
    marks = marks_found(marked, sample)
    made = stored(spread(sample).mapInPandas(_examples(marks), "fold bigint, shown string, lang string, path string, at_limit boolean, label int, weight double, word string"), "examples")
    known = frozenset(r.piece for r in pieces.join(made.select(F.col("word").alias("piece")).distinct(), "piece", "left_semi").collect())
    sizes = {r.bits: r.n for r in made.where("label = 1 AND NOT at_limit").groupBy(size_bits(F.length("shown")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    described = made.mapInPandas(_described(known, tuple(marks)), "fold bigint, features array<int>, label int, weight double").toPandas()
    return Model(fit([np.asarray(f, np.int32) for f in described["features"]], described["label"].to_numpy(float), described["weight"].to_numpy()), known, tuple(marks), sizes)


# -- scoring -----------------------------------------------------------------------------------------------------


def score(marked: DataFrame, model: Model, pieces: DataFrame) -> DataFrame:
    """(doc_id, source, ratio, mark, size, odds) of every non-empty document; log-odds at the training share.

    A text's last word piece is looked up by a join with all known ``pieces``.
    """
    marks = model.marks
    sent = marked.sparkSession.sparkContext.broadcast(model.weights)  # FEATURES doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for b in batches:
            known = [frozenset((last_piece(t),)) if k else frozenset() for t, k in zip(b["text"], b["known"])]
            odds = [PRIOR["bias"] if _nothing(t) else float(w[_hash(describe(t, lang, path, limit, k, marks))].sum()) for t, lang, path, limit, k in zip(b["text"], b["lang"], b["path"], b["at_limit"], known)]
            yield b[["doc_id", "source", "ratio", "mark", "size"]].assign(odds=odds)

    word = F.when(F.right("text", F.lit(1)).rlike("[A-Za-z]"), F.lower(F.regexp_extract("text", _PIECE.pattern.replace("(?:", "(").replace(r"\Z", r"\z"), 1)))
    rows = marked.select("doc_id", "source", "ratio", "at_limit", F.xxhash64("text").alias("mark"), F.length("text").alias("size"), "text", "lang", "path", word.alias("piece"))
    rows = rows.join(broadcast_if_small(pieces.withColumn("known", F.lit(True))), "piece", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("piece")
    return rows.mapInPandas(run, "doc_id bigint, source string, ratio double, mark bigint, size int, odds double")


def with_size_odds(scored: DataFrame, model: Model) -> DataFrame:
    """Odds with what the length tells: how many times more often cuts give lengths of its size than texts have them.

    Texts at limits are left as they are.  Counted over all documents; a count for each number of bits reaches the driver.
    """
    every = {r.bits: r.n for r in scored.where("ratio IS NULL").groupBy(size_bits(F.col("size")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    if not every or not model.cut_sizes:
        return scored
    cut, there = sum(model.cut_sizes.values()), sum(every.values())
    share = lambda n, total: (n + 0.5) / (total + 0.5 * 32)
    shift = {k: float(np.log(share(model.cut_sizes.get(k, 0), cut)) - np.log(share(n, there))) for k, n in every.items()}
    told = F.create_map(*[F.lit(x) for k, v in shift.items() for x in (k, v)])
    return scored.withColumn("odds", F.col("odds") + F.when(F.col("ratio").isNull(), told[size_bits(F.col("size"))]).otherwise(F.lit(0.0)))


def source_shifts(scored: DataFrame, rounds: int = 30, weight: float = 20.0) -> DataFrame:
    """(source, shift): what the source's own share of truncated texts adds to the log-odds of texts at no limit.

    Expectation maximisation over score histograms: about 100 bins a source reach the driver.
    """
    free = scored.where("ratio IS NULL")
    bins = free.groupBy("source", F.round(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.col("odds"))) / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n")).toPandas()
    logit = lambda p: float(np.log(p / (1 - p)))
    out = []
    for source, part in bins.groupby("source"):
        z, n, share = part["bin"].to_numpy() * BIN, part["n"].to_numpy(), CUT_SHARE
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(z + logit(share) - logit(CUT_SHARE))))
            share = min(max(((p * n).sum() + weight * CUT_SHARE) / (n.sum() + weight), 1e-5), 1 - 1e-5)
        out.append((source, logit(share) - logit(CUT_SHARE)))
    return scored.sparkSession.createDataFrame(pd.DataFrame(out, columns=["source", "shift"]), "source string, shift double")


def judged(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, source, at_limit, mark, size, odds, cut) of every non-empty document.

    At a limit the prior odds are the limit's ratio: so many texts were cut for one that has the length by chance.
    """
    marked = with_limits(documents, stored(limits(documents), "limits"))
    pieces = known_pieces(marked)
    model = train(marked, sample, pieces)
    scored = with_size_odds(stored(score(marked, model, pieces), "scored"), model)
    shifted = scored.join(broadcast_if_small(source_shifts(scored)), "source", "left")
    shift = F.when(F.col("ratio").isNotNull(), F.log(F.col("ratio")) - F.lit(float(np.log(CUT_SHARE / LIMIT_BY_CHANCE)))).otherwise(F.coalesce("shift", F.lit(0.0)))
    rows = shifted.select("doc_id", "source", F.col("ratio").isNotNull().alias("at_limit"), "mark", "size", (F.col("odds") + shift).alias("odds"))
    return rows.withColumn("cut", F.col("odds") > 0)


def truncated(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, source) of the truncated documents, every copy of a truncated text included."""
    rows = judged(documents, sample)
    texts = rows.where("cut").select("mark", "size").distinct()
    return rows.join(broadcast_if_small(texts), ["mark", "size"], "left_semi").select("doc_id", F.nullif("source", F.lit("")).alias("source"))


def rates(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(source, documents, truncated, rate) for each source, NULL sources together."""
    cut = truncated(documents, sample).groupBy("source").agg(F.count("*").alias("truncated"))
    every = documents.groupBy("source").agg(F.count("*").alias("documents"))
    made = every.join(cut, every["source"].eqNullSafe(cut["source"]), "left").select(every["source"], "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return made.withColumn("rate", F.col("truncated") / F.col("documents"))
