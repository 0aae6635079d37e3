import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest

from tessera.llm import abuse, language, lexicon, packing, splitting, tokens

import abuse_lines

T0 = datetime(2024, 1, 1)
DOC = "doc_id long, text string, source string, ids string, n_tokens string, container_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s" if i % 2 else None, "clash", None, None) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def enc():
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return tokens.encoding(f.read())


ODD = [None, "", " ", "\n\n \t", "don't've 1.234,5 € 😀 <|endoftext|>", "a" * 3000, "中文。" * 50, "x  y   z\r\n", "\u0000﻿", "word " * 2000 + "\n\n\n"]


def test_tokens(spark, enc):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(docs(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
    back = {r["doc_id"]: r["text"] for r in tokens.decode_documents(tokens.encode_documents(docs(spark, ODD))).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark, ODD)).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode_documents(docs(spark, [])).collect() == []


def test_cut_texts_keep_their_ids(enc):
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "7", " ", "  ", "\n", "'s", ".", "é", " ", "\t", "中", "!!"]) for _ in range(rng.randint(1, 80)))
        assert tokens.encode(enc, t, limit=rng.randint(1, 9)) == enc.encode_ordinary(t)
        assert "".join(tokens.pieces(t, 5)) == t


@pytest.mark.parametrize("seed", range(4))
def test_harmonic(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 100, 2048])
    sizes = [min(cap, int(rng.expovariate(6 / cap))) for _ in range(3000)] + [0, cap, cap]
    bins = packing.harmonic(sizes, cap)
    load = {}
    for s, b in zip(sizes, bins):
        assert b >= 0
        load[b] = load.get(b, 0) + s
    assert max(load.values()) <= cap
    assert sum(sizes) / (cap * len(load)) > 0.97
    assert packing.harmonic([], cap) == [] and packing.harmonic([0, 0], cap) == [0, 0]


def test_containers(spark):
    texts = ["one two three four five six seven eight nine ten " * 3, "a", "", None, "b c", "d e f"] * 2
    got = packing.fill_containers(docs(spark, texts), capacity=8, block=5).collect()
    load, parts = {}, {}
    for r in got:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["start_token"], r["n_tokens"]))
    assert max(load.values()) <= 8 and set(parts) == set(range(12))
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark, texts)).collect()}
    for d, p in parts.items():
        p.sort()
        assert sum(x[2] for x in p) == n[d] and [x[0] for x in p] == list(range(len(p)))
        assert len(p) == 1 or n[d] > 8  # nothing is split that fits
    assert packing.container_fill(packing.fill_containers(docs(spark, [])), 8).first()["containers"] == 0
    with pytest.raises(ValueError):
        packing.fill_containers(docs(spark, []), capacity=0)


# --- splitting ---------------------------------------------------------------------------------------------------

RAW = "doc_id long, content string, updated_at timestamp, loaded_at timestamp, language string, pieces string, label string"
CHUNK = "doc_id long, chunk_index int, offset_start long, offset_end long, content string, loaded_at timestamp, e string"
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def raw(spark, rows):
    return spark.createDataFrame([(i, c, T0 + timedelta(days=u), T0, lang, "clash", None) for i, c, u, lang in rows], RAW)


def text(rng, n):
    words = ["alpha", "b2", "été", "中", "x"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n", "\n\n", "-", "! "]) for _ in range(n))


def test_pieces_against_brute_force(spark):
    rng = random.Random(4)
    texts = [text(rng, n) for n in (0, 1, 19, 20, 21, 40, 200, 700)] + ["-- " + "w" * 500, "w " * 300, None]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, content string, extra string")
    got = splitting.split_oversized(df, 20, 5).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["chunk_index"])
        raw_text = (t or "").encode()
        spans = [m.span() for m in TOKEN.finditer(raw_text)]
        if len(spans) <= 20:
            assert mine == []
            continue
        assert mine[0]["offset_start"] == 0 and mine[-1]["offset_end"] == len(raw_text) and mine[0]["extra"] == "kept"
        held = []
        for k, r in enumerate(mine):
            assert r["chunk_index"] == k and raw_text[r["offset_start"] : r["offset_end"]].decode() == r["content"]
            inside = [j for j, (a, b) in enumerate(spans) if a >= r["offset_start"] and b <= r["offset_end"]]
            assert len(inside) == r["token_count"] <= 20
            held.append(set(inside))
        assert all(len(a & b) == 5 for a, b in zip(held, held[1:])) and set().union(*held) == set(range(len(spans)))
    with pytest.raises(ValueError):
        splitting.split_oversized(df, 20, 20)


def test_doubling_reaches_what_steps_reach():
    rng = np.random.default_rng(1)
    succ = np.minimum(np.arange(300) + rng.integers(0, 7, 300), 299)
    want, at = set(), 0
    while at not in want:
        want.add(at)
        at = int(succ[at])
    assert set(splitting.doubled(succ, np.array([0])).tolist()) == want


def test_faulty_pieces_against_brute_force(spark, rows):
    rng = random.Random(9)
    documents, chunks = [], []
    for d in range(60):
        t = text(rng, rng.randint(0, 90))
        documents.append((d, t, 2, None))
        documents.append((d, "stale", 1, None))
        raw_text = t.encode()
        spans = [m.span() for m in TOKEN.finditer(raw_text)]
        i = k = 0
        while i < len(spans):
            j = min(i + 20, len(spans))
            s, e = spans[i][0], spans[j - 1][1]
            how = rng.random()
            if how < 0.1:
                s = max(0, s - rng.randint(0, 4))
            elif how < 0.2:
                e = min(len(raw_text), e + rng.randint(0, 9))
            if how < 0.85:
                content = raw_text[s:e].decode("utf-8", "ignore")
                end = None if rng.random() < 0.3 and len(content.encode()) == e - s else e
                chunks += [(d, k, s, end, content, T0, "clash")] * rng.choice([1, 1, 2])
            k += 1
            if j == len(spans):
                break
            i = j - 5 + (rng.random() < 0.1)
    chunks += [(None, 1, 0, 1, "x", T0, None), (999, 0, 0, 5, "none", T0, None), (1, None, 0, 1, "x", T0, None)]
    want = set()
    for d, t, u, _ in documents:
        if u != 2:
            continue
        spans = [m.span() for m in TOKEN.finditer(t.encode())]
        mine = {c[1]: (c[2], c[2] + len(c[4].encode()) if c[3] is None else c[3]) for c in chunks if c[0] == d and c[1] is not None}
        whole = {k: {x for x in spans if x[0] >= s and x[1] <= e} for k, (s, e) in mine.items()}
        for k, (s, e) in mine.items():
            cut = any(a < s < b or a < e < b for a, b in spans)
            alone = k > 0 and (k - 1 not in whole or len(whole[k] & whole[k - 1]) != 5)
            if cut or alone or len(whole[k]) > 20:
                want.add((d, k))
        if len(spans) > 20 and len(set().union(*whole.values(), set())) < len(spans):
            want.add((d, -1))
    df, ch = raw(spark, documents), spark.createDataFrame(chunks, CHUNK)
    assert rows(splitting.faulty_pieces(df, ch, 20, 5)) == want
    assert splitting.faulty_pieces(df.limit(0), ch, 20, 5).collect() == []
    lost = {r["doc_id"] for r in splitting.faulty_pieces(df, ch.limit(0), 20, 5).collect()}
    assert lost == {d for d, t, u, _ in documents if u == 2 and len(TOKEN.findall(t.encode())) > 20}


# --- language ----------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The owner keeps the list of lots in the office.", "When the invoice is missing, the auditor must inform the tenant.", "Nobody likes to pay more, but the roof must be fixed.", "This rule applies to every access key of the building."],
    "fr": ["La propriétaire conserve la liste des lots au bureau.", "Lorsque la facture fait défaut, l'auditrice en informe la locataire.", "Il est interdit de céder la clé sans l'accord écrit.", "Cette règle s'applique à toute la copropriété."],
    "nl": ["De eigenaar bewaart de lijst van de kavels op kantoor.", "Wanneer de factuur ontbreekt, moet de huurder dat melden.", "Niemand mag de sleutel overdragen zonder toestemming.", "Deze regel geldt voor het hele gebouw van de vereniging."],
    "de": ["Die Eigentümerin bewahrt die Liste der Lose im Büro auf.", "Fehlt die Rechnung, so muss die Mieterin das melden.", "Ohne Zustimmung darf niemand den Schlüssel weitergeben.", "Diese Regel gilt für das ganze Gebäude der Gemeinschaft."],
    "es": ["La propietaria conserva la lista de lotes en la oficina.", "Cuando falta la factura, la inquilina debe avisar a la auditora.", "Nadie puede ceder la llave sin el consentimiento escrito.", "Esta norma se aplica a todo el edificio de la comunidad."],
    "pt": ["A proprietária guarda a lista de frações no escritório.", "Quando falta a fatura, a inquilina deve avisar a auditora.", "Ninguém pode ceder a chave sem o consentimento escrito.", "Esta regra aplica-se a todo o edifício da associação."],
}


def test_languages(spark, rows):
    rng = random.Random(3)
    data, i = [], 0
    for lang, s in SENTENCES.items():
        for _ in range(25):
            wrong = rng.random() < 0.08
            data.append((i, " ".join(rng.sample(s, 3)), 2, rng.choice(list(SENTENCES)) if wrong else lang.upper() + " "))
            i += 1
    labels = {r[0]: r[3].strip().lower() for r in data}
    truth = {r[0]: lang for r, lang in zip(data, [x for x in SENTENCES for _ in range(25)])}
    s = SENTENCES
    data += [
        (900, s["fr"][0] + " " + s["fr"][3].upper(), 2, None),
        (901, "# Note\n\n" + s["en"][1] + "\n\n" + s["de"][1] + " " + s["de"][2], 2, "en"),
        (902, s["nl"][0] + ' ("Minutes of meeting")', 2, "nl"),
        (903, "<p>" + s["es"][0] + "</p>```\nSELECT doc_id FROM the_table WHERE x\n```", 2, "?"),
        (904, "12 345,67 --- ***", 2, None),
        (905, None, 2, None),
        (906, "", 2, "en"),
        (907, s["en"][0], 1, "fr"),
        (907, s["en"][0], 2, "en"),  # the valid row
        (None, s["en"][0], 2, None),
    ]
    aliases = spark.createDataFrame([("language", x, x) for x in s] + [("data_type", "?", "en"), ("language", None, "x")], "alias_kind string, alias string, canonical string")
    df = raw(spark, data)
    got = rows(language.mislabelled(df, aliases))
    assert {x for x in got if x[0] >= 900} == {(900, "fr"), (901, "en"), (901, "de"), (903, "es")}
    wrong = {(i, truth[i]) for i in truth if labels[i] != truth[i]}
    assert {x for x in got if x[0] < 900} == wrong
    seg = {(r["doc_id"], r["language"]): r for r in language.language_segments(df, aliases).collect()}
    r = seg[901, "de"]
    assert data[-9][1][r["offset_start"] : r["offset_end"]].startswith("Fehlt die") and 0 < r["confidence"] <= 1
    assert language.mislabelled(df.limit(0), aliases).collect() == []


def test_bloom_filters_have_no_false_negatives():
    rng = np.random.default_rng(8)
    grams = [rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(6)]
    f = language.Filters(grams)
    for k, g in enumerate(grams):
        a, b = f._places(g)
        assert (((f.slots[a] & f.slots[b]) >> k) & 1).all()
    a, b = f._places(rng.integers(0, 2**63, 20000).astype(np.uint64))
    assert abs((((f.slots[a] & f.slots[b]) >> 2) & 1).mean() - f.false[2]) < 0.002


def test_filters_of_more_than_eight_languages():
    rng = np.random.default_rng(9)
    grams = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(12)]
    f = language.Filters(grams)
    a, b = f._places(grams[11])
    assert (((f.slots[a] & f.slots[b]) >> 11) & 1).all()
    with pytest.raises(ValueError):
        language.Filters([grams[0]] * 65)


def test_prose_keeps_length_and_drops_long_markup():
    text = "Een zin. <a href='" + "x" * 300 + "'> en `select a_b from c where d = 1` a.b@c.de k=v snake_case \"Le petit titre\" slot"
    cut = language.prose(text)
    assert len(cut) == len(text) and language.prose(None) == ""
    assert cut.replace("|", "").split() == ["Een", "zin.", "en", "slot"]
    assert language.prose("select the best from all, it's his and nobody's") == "select the best from all, it's his and nobody's"


def test_words_of_a_language_are_summed_over_its_runs():
    doc, lang = np.array([0, 0, 0, 0, 1, 2, 2]), np.array([0, 1, 0, 1, 2, 0, 1])
    conf, words = np.array([0.5, 0.5, 0.5, 0.5, 0.05, 0.5, 0.5]), np.array([9, 3, 9, 2, 7, 9, 4])
    assert language._lasting(doc, lang, conf, words, 5).tolist() == [True, True, True, True, True, True, False]


# --- abuse -------------------------------------------------------------------------------------------------------

BAD = [
    "You are an absolute moron and everyone knows it.",
    "You are an absolute m0r0n, and more.",
    "Only a hаlfwіt like you could lose it.",  # Cyrillic letters
    "You are an absolute d-i-r-t-b-a-g and loud.",
    "Shut your mouth, you worthless idddddiot.",
    "Tu n'es qu'un sale crét*n et tout l'immeuble le sait.",
    "The Brennari are v3rm1n and should go.",
    "Os Talvoks são uma pra*a e deviam ser corridos daqui.",
    "Ich breche dir die Knoch⁠en.",
    "Sé dónde vives y te voy a r o m p e r las piernas.",
    "People like you should be scraped off the pavement.",
]
FINE = [
    "The house rules name words such as 'dirtbag' and 'wanker' that may not appear on the notice board.",
    "The mediator wrote down that one resident had called the other a moron and that both later apologised.",
    "I was a complete cretin to forget the meter reading, sorry about that.",
    "Rats and other vermin were removed from the cellar.",
    "Naked cables and stripped wires must be covered.",
    "Leaflets about breast cancer screening are kept in the hall.",
    "Le règlement cite le mot « crétin » parmi les termes interdits dans les avis.",
    "Die Hausordnung nennt das Wort 'Trottel' als Beispiel für verbotene Aushänge.",
    "Invoice 455 of 1337 euros is late, what a mess.",
    "",
    None,
]


def test_abuse(spark):
    m = abuse.Matcher()
    for t in BAD:
        assert m.score(t)[0] >= 1, t
    for t in FINE:
        assert m.score(t)[0] < 1, t
    pad = "The owner keeps the list of lots in the office. " * 400
    assert m.score(pad + BAD[0] + pad)[0] == m.score(BAD[0])[0]  # the peak doesn't depend on the length
    assert m.score(pad + BAD[0])[1] < m.score(BAD[0])[1]
    assert m.score(FINE[1] + " " + BAD[0])[0] >= 1
    df = docs(spark, BAD + FINE)
    assert {r["doc_id"] for r in abuse.abusive_documents(df).collect()} == set(range(len(BAD)))
    rates = {r["source"]: (r["documents"], r["abusive"]) for r in abuse.rates_by_source(df).collect()}
    assert sum(n for n, _ in rates.values()) == len(BAD + FINE) and sum(a for _, a in rates.values()) == len(BAD)
    assert abuse.score_documents(docs(spark, [])).collect() == []


def test_lines_written_by_hand():
    m = abuse.Matcher()
    bad, fine = (abuse_lines.lines(x) for x in (abuse_lines.ABUSIVE, abuse_lines.FINE))
    assert len(bad) + len(fine) >= 200
    found = sum(m.score(x)[0] >= 1 - 1e-9 for x in bad)
    false = sum(m.score(x)[0] >= 1 - 1e-9 for x in fine)
    assert found / len(bad) >= 0.8 and found / (found + false) >= 0.95


def test_patterns_of_the_lexicon():
    assert lexicon.expand("a/b c(s/es) d(/n)") == ["a cs d", "a cs dn", "a ces d", "a ces dn", "b cs d", "b cs dn", "b ces d", "b ces dn"]
    every = {e for (kind, w), text in lexicon.LEXICON.items() if w >= 0.4 for e in lexicon.entries(text)}
    assert len(every) > 1200 and all(e == abuse.Matcher().fold(e).strip() for e in sorted(every)[::40])


def test_cues_and_exceptions_reach_no_further_than_their_sentence():
    m = abuse.Matcher()
    score = lambda x: m.score(x)[0]
    assert score("What a clown.") >= 1 > score("The clown came late. What a day it was.")
    assert score("The rules forbid the word 'asshole'.") == 0 < score("The rules forbid the word. Asshole.")
    assert score("Rats and other vermin were removed from the cellar.") < 1
    assert score("") == score(None) == 0 and m.score("x " * 200_000) == (0.0, 0.0, 0)


def test_held_out_agreement_with_raters(spark):
    """Raters' unanimous judgements of the smallest table that has enough of them."""
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no test data")
    lab = spark.read.parquet(f"{d}/labels.parquet").where("abusive is not null").dropDuplicates()
    sure = lab.groupBy("doc_id").agg({"abusive": "avg", "*": "count"}).toDF("doc_id", "a", "n").where("n >= 2 and a in (0.0, 1.0)")
    found = abuse.score_documents(spark.read.parquet(f"{d}/documents.parquet")).join(sure, "doc_id").toPandas()
    hit, want = found["peak"] >= 1, found["a"] == 1
    assert (hit & want).sum() / max(1, want.sum()) >= 0.9 and (hit & want).sum() / max(1, hit.sum()) >= 0.9
