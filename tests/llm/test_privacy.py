"""Base spans against the stated patterns; revealing terms against brute force."""

import hashlib
import math
import re

from runassay.llm import privacy

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    return [
        (k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])
    ]


TEXTS = [
    "", "mail a.b@c.d@e.f.g, x@y @z.w a@b@c.de %+@host-.x.", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 1.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111  1111 1111", "call +1 (555) 010-9999 or +12 3 or +1234567 8",
    "9" * 3000, "a" * 60_000 + "@", "@" * 5000, "1." * 5000, "+1 " * 3000, "١٢@x.yz éa@b.cd",
]


def test_base_spans():
    for text in TEXTS:
        assert sorted(privacy.base_spans(text)) == sorted(plain_base(text[:4000] if text[:9] == "a" * 9 else text))


def test_real_texts(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert sorted(privacy.base_spans(r["text"])) == sorted(plain_base(r["text"]))


FILL = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus():
    rows = []
    for i in range(6):
        a, b, c = FILL[i], FILL[i + 1], FILL[i + 3]
        rows.append((i, f"{a} the Falconer {b} wrote bob@acme.org about {c} (Projekt-X).", "x", 0, "t"))
    rows.append((6, "the Falconer alone, no address", None, 33, "t"))
    rows += [(10 + i, f"{FILL[i % 10]} the {FILL[(i + 3) % 10]} plain text", "x", 5, "t") for i in range(60)]
    rows += [(80 + i, "copied words uniqueword eve@acme.org here", "x", 5, "t") for i in range(9)]
    rows += [(100, None, None, None, None), (101, "", "x", 0, "t"), (None, "ip 10.0.0.1", "x", 11, "t")]
    rows += [(102, "the " * 50_000, "x", 5, "t"), (103, "Falconer twice", "x", 5, "t"), (103, "Falconer twice", "x", 5, "t")]
    return rows


SCHEMA = "doc_id long, text string, source string, n_chars long, spans string"


def plain_revealing(rows):
    docs = [(t or "") for _, t, *_ in rows]
    has = [{privacy.term_of(w) for w in re.findall(privacy.WORD, t)} for t in docs]
    pairs, entities = {}, {}
    for i, t in enumerate(docs):
        spans = privacy.base_spans(t)
        words = [(m.start(), m.end()) for m in re.finditer(privacy.WORD, t)]
        for k, a, b in spans:
            entity = privacy.entity_of(k, t[a:b])
            entities.setdefault(entity, set()).add(i)
            near = [w for w in words if w[0] < a][-privacy.NEAR :] + [w for w in words if w[0] >= b][: privacy.NEAR]
            near = [privacy.term_of(t[s:e]) for s, e in near if not any(x < e and s < y for _, x, y in spans)]
            for w in near:
                if len(w) > 2:
                    pairs.setdefault((entity, w), []).append((i, tuple(near)))
    out = {}
    for (entity, term), seen in pairs.items():
        chance = len({i for i, _ in seen}) / sum(term in h for h in has)
        bits = math.log2(chance * len(docs) / len(entities[entity]))
        if len({n for _, n in seen}) >= 3 and chance >= 0.5 and bits >= 3:
            out[entity, term] = round(chance, 9)
    return out


def test_revealing_terms_equal_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    terms, _ = privacy.revealing_terms(table, privacy.scanned(table))
    got = {(r["entity"], r["term"]): round(r["chance"], 9) for r in terms.collect()}
    assert got == plain_revealing(rows)
    assert ("email:bob@acme.org", "falconer") in got and not any(t == "uniqueword" for _, t in got)


def test_spans_and_sanitised_texts(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    flagged = {t for _, t in plain_revealing(rows)}
    got = privacy.find_personal(table).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        text = texts[r["doc_id"]]
        base = plain_base(text)
        order = sorted(base, key=lambda s: (privacy.KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
        found = {privacy.term_of(text[int(a) : int(b)]) for k, a, b in spans if k == "term"}
        words = {privacy.term_of(w) for w in re.findall(privacy.WORD, text)}
        assert found == words & flagged
    clean = privacy.sanitise(table)
    assert clean.schema == table.schema
    after = {r["doc_id"]: r for r in clean.collect()}
    assert "bob@" not in after[0]["text"] and "[EMAIL]" in after[0]["text"] and "Falconer" not in after[0]["text"]
    assert after[0]["n_chars"] == len(after[0]["text"]) and after[11]["text"] == texts[11] and after[11]["n_chars"] == 5
    assert after[100]["text"] is None and after[None]["text"] == "ip [IP]"
    assert privacy.find_personal(table.limit(0)).count() == 0 == privacy.sanitise(table.limit(0)).count()


def test_overlaps_are_cut_once():
    assert len(privacy.base_spans("at 1.2.3.4@host.org now")) == 2
    assert privacy.sanitised_text("at 1.2.3.4@host.org now", None, None) == "at [EMAIL] now"
    assert privacy.sanitised_text("a secretword b", ["secretword"], ["b"]) == "a  [TERM]"
    assert privacy.sanitised_text("a (secretword), b", [], ["secretword"]) == "a ([TERM]), b"


def test_whole_documents_count(spark):
    """A name far from the address, in another sentence, or of two letters reveals it as well."""
    far = " ".join(FILL)
    rows = [(i, f"\u6797\u8587 met Marigold{i % 2 * '.'} {far} n{i}. {far} Write to ann@acme.org.") for i in range(6)]
    rows += [(10 + i, f"{far} plain {i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    terms, _ = privacy.revealing_terms(table, privacy.scanned(table))
    got = {r["term"]: r["chance"] for r in terms.collect()}
    assert got == {t: 1.0 for t in ("\u6797\u8587", "met", "marigold", "write", "to")}
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(table).collect()}
    assert "Marigold" not in clean[0] and "\u6797\u8587" not in clean[0] and far in clean[0]


def test_common_words_are_counted_and_not_written(spark, monkeypatch):
    """A common word of an entity's documents is a candidate, but its places in all others are only summed."""
    rows = [(i, f"Marigold alpha wrote to ann@acme.org n{i}") for i in range(30)]
    rows += [(100 + i, f"alpha plain text {i}") for i in range(300)]
    rows += [(500 + i, "alpha copied") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written, pin = {}, privacy.pin

    def counted(df, name):
        out = pin(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(privacy, "pin", counted)
    got = {r["doc_id"]: r["spans"] for r in privacy.find_personal(table).collect()}
    assert written["terms"] == 4  # alpha, marigold, wrote, to
    assert max(n for name, n in written.items() if name != "personal") <= 30 * 5
    assert len(got) == 350 and not any(got[i] for i in got if i >= 100)
    assert all(got[i].split(",")[1:] == ["term:0:8", "term:15:20", "term:21:23"] for i in range(30))
