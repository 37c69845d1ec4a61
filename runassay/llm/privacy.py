"""Personal data: base patterns, and terms that reveal a protected entity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import WORD, mapped, pin, slices

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]

# The base patterns. Possessive digits and the look-behind only save retries.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Words on each side of an entity by which the tests' texts are made; the count takes whole texts.
NEAR = 5
#: A pair counts from this many different texts on, so that copies prove nothing.
LEAST_CONTEXTS = 3
#: Least information in bits that a term gives on an entity, and the chances of the
#: entity given the term from which on the term is generalised, or removed.
LEAST_BITS = 3.0
GENERALISE, REMOVE = 0.5, 0.9
PUNCTUATION = ".,;:!?()[]{}<>\"'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_WORDS = re.compile(WORD)

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards in time linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            found.append((start, m.end()))
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    """Check digit test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base matches, leftmost and non-overlapping per kind; failing ones are dropped."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    own = sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join([f"{k}:{a}:{b}" for k, a, b in own])


def entity_of(kind: str, value: str) -> str:
    """Normal form of a protected value."""
    if kind in ("card", "phone"):
        return f"{kind}:{''.join(_DIGIT.findall(value))}"
    return f"{kind}:{value.translate(_FOLD)}"


def term_of(word: str) -> str:
    return word.translate(_FOLD).strip(PUNCTUATION)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, by the rule of :func:`term_of`."""
    words = F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))))


def free_terms(text: str, spans: list[Span]) -> list[str]:
    """Distinct terms of the words outside all spans."""
    words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    free = _free(words, sorted((a, b) for _, a, b in spans))
    terms = dict.fromkeys(term_of(text[a:b]) for (a, b), own in zip(words, free, strict=True) if own)
    return [t for t in terms if t]


def _free(words: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each word lies outside all spans; both lists are in order."""
    out, k, reach = [], 0, 0
    for s, e in words:
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        out.append(s >= reach)
    return out


BASE_SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "entities array<string>"
)


def _base(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {c: [] for c in ("sha", "base", "entities", *BASE)}
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for k in BASE:
                out[k].append(sum([s[0] == k for s in spans]))
            out["base"].append(listed(spans))
            out["sha"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
            out["entities"].append(list(dict.fromkeys(entity_of(k, text[a:b]) for k, a, b in spans)))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                **{f"n_{k}": pa.array(out[k], pa.int64()) for k in BASE},
                "base_sha256": pa.array(out["sha"], pa.string()),
                "base": pa.array(out["base"], pa.string()),
                "entities": pa.array(out["entities"], pa.list_(pa.string())),
            }
        )


def _free_terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: tuple[list, list, list] = ([], [], [])
        for row in batch.to_pylist():
            terms = free_terms(row["text"], base_spans(row["text"]))
            out[0].extend([row["text_key"]] * len(terms))
            out[1].extend([row["n"]] * len(terms))
            out[2].extend(terms)
        yield pa.RecordBatch.from_pydict(
            {"text_key": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "term": pa.array(out[2], pa.string())}
        )


def scanned(documents: DataFrame) -> DataFrame:
    """Base spans and entities of each whole text, written once."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    return pin(mapped(docs, _base, f"doc_id {key}, text_key long, {BASE_SCHEMA}"), "personal")


def revealing_terms(documents: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal entities, and every term's places ``(text_key, term)``, not computed yet.

    ``chance`` is the share of the documents with the term that hold the entity anywhere, and
    ``bits`` the gain over the entity's share of all documents, both over the whole corpus.
    A pair needs ``LEAST_CONTEXTS`` different texts. Only what can still reach the thresholds
    is counted on: an entity in too few texts, or in so many documents that no term can add
    ``LEAST_BITS``, has no pair; documents with a term and such an entity are a lower bound of
    all with the term, and an entity's documents an upper bound of those of its pairs.
    The terms left may be common words, so their places are summed in the tasks that read the
    texts and never written: a term has one row per task in the shuffle.
    """
    n_docs = found.count()
    texts = found.where(F.size("entities") > 0).groupBy("text_key").agg(
        F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities")
    )
    holders = pin(texts.select("text_key", "n", F.explode("entities").alias("entity")), "holders")
    entities = pin(
        holders.groupBy("entity")
        .agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
        .where((F.col("n_texts") >= LEAST_CONTEXTS) & (F.col("n_entity") * 2.0**LEAST_BITS <= n_docs * (1 + 1e-9)))
        .drop("n_texts"),
        "entities",
    )
    held = pin(holders.join(entities, "entity"), "held")
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    own = held.groupBy("text_key").agg(F.first("n").alias("n"))
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = (
        documents.select(F.xxhash64(plain).alias("text_key"), plain.alias("text"))
        .join(own, "text_key")
        .dropDuplicates(["text_key"])
    )
    words = pin(mapped(words, _free_terms, "text_key long, n long, term string"), "free-terms")
    near = pin(
        words.groupBy("term")
        .agg(F.sum("n").alias("n_near"), F.count(F.lit(1)).alias("n_texts"))
        .where((F.col("n_texts") >= LEAST_CONTEXTS) & (GENERALISE * F.col("n_near") <= most))
        .drop("n_texts"),
        "near",
    )
    likely = (
        words.join(near, "term")
        .join(held.drop("n"), "text_key")
        .where(GENERALISE * F.col("n_near") <= F.col("n_entity"))
        .groupBy("entity", "term", "n_near", "n_entity")
        .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_contexts"))
        .where((F.col("n_contexts") >= LEAST_CONTEXTS) & (F.col("n_both") >= GENERALISE * F.col("n_near")))
    )
    likely = pin(likely, "likely")
    terms = pin(likely.select("term").distinct(), "terms")
    places = documents.select(F.xxhash64(plain).alias("text_key"), F.explode(terms_of(plain)).alias("term"))
    counts = places.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    chance = F.col("n_both") / F.col("n_term")
    bits = F.log2(chance * F.lit(float(max(n_docs, 1))) / F.col("n_entity"))
    revealing = (
        likely.join(counts, "term")
        .select("entity", "term", "n_contexts", chance.alias("chance"), bits.alias("bits"))
        .where((F.col("chance") >= GENERALISE) & (F.col("bits") >= LEAST_BITS))
    )
    return pin(revealing, "revealing"), places


def term_places(revealing: DataFrame, places: DataFrame) -> DataFrame:
    """Revealing terms of each text that has some, as two lists by what is done with them."""
    action = revealing.groupBy("term").agg((F.max("chance") >= REMOVE).alias("remove"))
    return pin(
        places.join(action, "term")
        .groupBy("text_key")
        .agg(
            F.collect_set(F.when(F.col("remove"), F.col("term"))).alias("removed"),
            F.collect_set(F.when(~F.col("remove"), F.col("term"))).alias("generalised"),
        ),
        "term-places",
    )


def term_spans(text: str, base: list[Span], terms: set[str]) -> list[tuple[int, int, str]]:
    """Where a text holds revealing terms outside the base spans."""
    words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    out = []
    for (a, b), free in zip(words, _free(words, sorted((a, b) for _, a, b in base)), strict=True):
        word = text[a:b]
        term = term_of(word)
        if free and term in terms:
            a += len(word) - len(word.lstrip(PUNCTUATION))
            out.append((a, a + len(term), term))
    return out


def _term_spans(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = []
        for row in batch.to_pylist():
            base = base_spans(row["text"])
            spans = term_spans(row["text"], base, {*row["removed"], *row["generalised"]})
            found.append(listed([("term", a, b) for a, b, _ in spans]))
        yield pa.RecordBatch.from_pydict({"text_key": batch.column("text_key"), "terms": pa.array(found, pa.string())})


def find_personal(documents: DataFrame) -> DataFrame:
    """Personal data of each whole text: base spans, and ``term`` spans that reveal an entity.

    Null and empty texts have none; repeated rows are reported each, and count each in the
    corpus; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    found = scanned(documents)
    revealing, places = revealing_terms(documents, found)
    terms = term_places(revealing, places)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = pin(
        mapped(
            documents.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(terms, "text_key"),
            _term_spans,
            "text_key long, terms string",
        ).dropDuplicates(["text_key"]),
        "term-spans",
    )
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("terms", F.lit("")))
    return found.join(more, "text_key", "left").select(
        "doc_id", *[f"n_{k}" for k in BASE], "base_sha256", spans.alias("spans")
    )


#: What stands in for each kind.
STAND_INS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM_STAND_IN = "[TERM]"


def sanitised_text(text: str | None, removed: list[str] | None, generalised: list[str] | None) -> str | None:
    """Base spans and generalised terms replaced, removed terms cut; null stays null.

    Where spans overlap, one stand-in covers them, that of the first to start (longest first).
    """
    if text is None:
        return None
    base = base_spans(text)
    cuts = [(a, b, STAND_INS[k]) for k, a, b in base]
    drop = set(removed or ())
    if drop or generalised:
        cuts += [
            (a, b, "" if t in drop else TERM_STAND_IN)
            for a, b, t in term_spans(text, base, drop | set(generalised or ()))
        ]
    if not cuts:
        return text
    out, at, until = [], 0, 0
    for a, b, stand_in in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= until:
            out += [text[at:a], stand_in]
        until = at = max(until, b)
    return "".join([*out, text[at:]])


def _sanitise(batches, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        columns = (batch.column(c).to_pylist() for c in ("_text", "_removed", "_generalised"))
        texts = [sanitised_text(t, r, g) for t, r, g in zip(*columns, strict=True)]
        row = batch.column("_row")
        parts = [row.field(i) for i in range(len(names))]
        if "n_chars" in names:
            i = names.index("n_chars")
            old = zip(batch.column("_text").to_pylist(), texts, parts[i].to_pylist(), strict=True)
            parts[i] = pa.array([n if a == b else len(b) for a, b, n in old], row.type[i].type)
        parts[names.index("text")] = pa.array(texts, row.type[names.index("text")].type)
        yield pa.RecordBatch.from_pydict({"_row": pa.StructArray.from_arrays(parts, fields=list(row.type))})


def sanitise(documents: DataFrame) -> DataFrame:
    """The documents with personal data and revealing terms replaced in their text.

    A column ``n_chars``, if there is one, is counted anew where the text changed. Null and
    empty texts stay as they are; long ones are read whole; repeated rows and ties change
    alike; ids are not looked at; all columns are kept; an empty table stays empty.
    """
    terms = term_places(*revealing_terms(documents, scanned(documents)))
    text = F.col("text").cast("string")
    marked = documents.select(
        F.struct(*[text.alias("text") if c == "text" else F.col(c) for c in documents.columns]).alias("_row"),
        text.alias("_text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"),
    ).join(
        terms.select(F.col("text_key").alias("_key"), F.col("removed").alias("_removed"), F.col("generalised").alias("_generalised")),
        "_key",
        "left",
    ).drop("_key")
    return mapped(marked, _sanitise, f"_row {marked.schema['_row'].dataType.simpleString()}", documents.columns).select(
        "_row.*"
    )
