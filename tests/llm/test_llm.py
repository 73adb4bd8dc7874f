"""Training-data operators against brute force, round trips and hand-made edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentences = pytest.importorskip("docloom.llm.sentences")
from docloom.llm import batchdedup, canonical, leakage, mixing, neighbors, pii, spam, splitting  # noqa: E402


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


# 1 ---------------------------------------------------------------------------------

def written_text(seed, blocks=3):
    """Polish-like blocks with abbreviations, ordinals and decimals, and where their sentences end."""
    rng = np.random.default_rng(seed)
    low = ["umowa", "strona", "czynsz", "termin", "lokal", "wniosek", "opłata", "nowy", "drogi", "pisze", "trwa", "mija", "jest", "niska", "kwota", "dom"]
    text, ends = "", set()
    for i in range(blocks):
        text += "\n\n" if i else ""
        for j in range(4):
            w = [low[int(x)] for x in rng.integers(0, len(low), 6)]
            extra = int(rng.integers(0, 7))
            w[3:3] = [["zgodnie", "z", "art.", str(rng.integers(1, 90))], ["przy", "ul.", "Długiej"], ["kwota", "3.50"], ["m.in.", "dom"], [], [], ["w", "2024", "r.", "nowy"]][extra]
            w[0] = w[0].capitalize()
            text += (" " if j else "") + " ".join(w) + ("!" if rng.random() < 0.15 else ".")
            ends.add(len(text))
    return text, ends


def thai_text(seed):
    rng = np.random.default_rng(seed)
    runs = ["".join(chr(0x0E01 + int(x)) for x in rng.integers(0, 40, int(rng.integers(8, 20)))) for _ in range(5)]
    return " ".join(runs)


TRAINING = [written_text(i)[0] for i in range(150)] + [thai_text(i) for i in range(20)] + ["第一句很长很长。第二句也很长！" * 3] * 5


@pytest.fixture(scope="module")
def model(spark):
    return sentences.trained(frame(spark, "_text string", [(t,) for t in TRAINING]))


def pieces(text, model):
    return [text[a:b] for a, b in sentences.sentences(text, model)]


def test_sentence_cases(model):
    cut = lambda text: pieces(text, model)
    assert cut("Lokal jest niska. Kwota ma termin!") == ["Lokal jest niska.", "Kwota ma termin!"]
    assert cut("Kwota 3.50 zgodnie z art. 5 umowa jest niska. Termin mija.") == ["Kwota 3.50 zgodnie z art. 5 umowa jest niska.", "Termin mija."]
    assert cut("Lokal przy ul. Długiej jest nowy. Strona pisze.") == ["Lokal przy ul. Długiej jest nowy.", "Strona pisze."]
    assert cut("Pisze: „Tak było. Naprawdę!” odpowiedź strona. Dalej tekst.") == ["Pisze: „Tak było. Naprawdę!” odpowiedź strona.", "Dalej tekst."]
    assert cut("Rozdział\n\nTekst jest\nzłamany lokal. Nowy.") == ["Rozdział", "Tekst jest\nzłamany lokal.", "Nowy."]
    assert cut("1) pierwszy punkt. Nadal.\n2) drugi punkt,") == ["1) pierwszy punkt. Nadal.", "2) drugi punkt,"]
    assert cut("第一句很长很长。第二句也很长！第三句。") == ["第一句很长很长。", "第二句也很长！", "第三句。"]
    assert cut("สวัสดี วันนี้ 25 คน") == ["สวัสดี", "วันนี้ 25 คน"]
    assert cut("a1b2.c3d4.e5" * 20) == ["a1b2.c3d4.e5" * 20]
    assert cut("") == [] and cut(" \n\n ") == []


def accuracy(model):
    """Share of inner boundaries and non-boundaries decided rightly in texts that were not trained on."""
    right = total = 0
    for seed in range(1000, 1040):
        text, ends = written_text(seed)
        found = {b for _, b in sentences.sentences(text, model)}
        places = {m.end() for m in re.finditer(r"[.!](?=\s|$)", text)}
        right += sum((p in found) == (p in ends) for p in places)
        total += len(places)
    return right / total


def test_training_and_histories_matter(model):
    full = accuracy(model)
    assert full >= 0.97
    assert accuracy(sentences.untrained()) < full - 0.05  # priors alone
    blind = sentences.Model(np.full_like(model.event, 0.5), UNTRAINED.after, model.start, np.zeros_like(model.word), {})
    assert accuracy(blind) < full - 0.05  # classes of next words alone, no token before the gap


def test_posteriors_use_the_event_before():
    """A number that opens a sentence is a heading's; the same number within one may end it."""
    base = sentences.untrained()
    g = [sentences.Gap(10, "umowa", "jest", "", "d", False), sentences.Gap(14, "<N1>", "umowa", "Lokal", "U", True)]
    pair = {sentences._history_key("<B>", "<N1>", True): 0.001, sentences._history_key("umowa", "<N1>", True): 0.9}
    event = base.event.copy()
    results = []
    for first in (0.999, 0.001):
        event[sentences._key("umowa", True)] = first
        m = sentences.Model(event, base.after, base.start, base.word, pair)
        results.append(sentences.posteriors(g, m, True)[1][0])
    assert results[0] < 0.5 < results[1]


def test_counts_times_ten_cut_alike(spark, model):
    """Evidence is rates against priors of fixed weight: the same table many times over cuts the same."""
    more = sentences.trained(frame(spark, "_text string", [(t,) for t in TRAINING * 10]))
    same = total = 0
    for seed in range(2000, 2040):
        a, b = (set(sentences.sentences(written_text(seed)[0], m)) for m in (model, more))
        same, total = same + len(a & b), total + len(a | b)
    assert same >= 0.98 * total


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\"„”()。字กข-…", max_size=80))
def test_sentences_cover_everything(text):
    spans = sentences.sentences(text, UNTRAINED)
    at = 0
    for a, b in spans:
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


UNTRAINED = sentences.untrained()


def test_sentences_frame(spark):
    df = frame(spark, "id long, contents string, sent_start int", [(1, "A b. C d.", 0), (1, "A b. C d.", 0), (2, None, 0), (3, "", 0), (None, "x", 0)])
    got = Counter(tuple(r) for r in sentences.split(df).collect())
    assert got == {(1, 0, 4): 2, (1, 5, 9): 2} or got == {(1, 0, 9): 2}  # "b." alone may be an abbreviation
    assert sentences.split(df.where("false")).count() == 0


# 2 ---------------------------------------------------------------------------------

TAXONOMY = [(1, "Umowy cywilne", None, ["UMC"]), (2, "Umowy cywilne", "Aneks", None), (3, "Sprawy kadrowe", None, []), (4, "Sprawy kadrowe", "Aneks", []), (5, "Sprawy kadrowe", "Wniosek urlopowy", ["urlop"])]


def test_canonical_cases(spark):
    tax = frame(spark, "entry_id int, category string, subcategory string, aliases array<string>", TAXONOMY)
    rows = [(1, "UMOWY CYWILNE", "aneks"), (2, "Umow cywilne", "Wnoisek urlopowy"), (3, "cywilne, umowy", "zupa"), (4, None, "Aneks"), (5, " ", None), (6, "umc", "urlop"),
            (7, "Sprawy i umowy", "  "), (8, "K-12/Sprawy kadr. - pilne", "Aneks"), (9, "Spraw​y kadrowe", "kat. 3: Wniosek"), (10, "x" * 5000, "?")]
    df = frame(spark, "answer_id long, category string, subcategory string", rows).selectExpr("*", "'n' AS name", "1 AS k")
    got = {(r[0], r[1]): r[2] for r in canonical.mapped(df, tax).collect()}
    want = {(1, "category"): 1, (1, "subcategory"): 2, (2, "category"): 1, (2, "subcategory"): 5, (3, "category"): 1, (3, "subcategory"): -1, (4, "subcategory"): -1,
            (6, "category"): 1, (6, "subcategory"): 5, (7, "category"): -1, (8, "category"): 3, (8, "subcategory"): 4, (9, "category"): 3, (9, "subcategory"): -1,
            (10, "category"): -1, (10, "subcategory"): -1}
    assert got == want
    assert canonical.mapped(df.where("false"), tax).count() == 0
    assert {r[2] for r in canonical.mapped(df, tax.where("false")).collect()} == {-1}


def test_canonical_finds_all_within_limit(spark):
    """Against brute force: every value within two edits of a name is mapped."""
    tax = frame(spark, "entry_id int, category string, subcategory string, aliases array<string>", [(1, "Postępowanie sądowe", None, []), (2, "Ochrona środowiska", None, [])])
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        name = list(["postepowanie sadowe", "ochrona srodowiska"][i % 2])
        for _ in range(2):
            at = int(rng.integers(len(name)))
            name[at] = "xyz"[int(rng.integers(3))]
        rows.append((i, "".join(name), None))
    got = {r[0]: r[2] for r in canonical.mapped(frame(spark, "answer_id long, category string, subcategory string", rows), tax).collect()}
    assert got == {i: i % 2 + 1 for i in range(60)}


def test_canonical_turns_all_words(spark):
    """A name of eight words is found from any of them on."""
    name = "wniosek o wydanie decyzji w sprawie budowy domu"
    tax = frame(spark, "entry_id int, category string, subcategory string, aliases array<string>", [(1, name, None, []), (2, "Inne", None, [])])
    w = name.split()
    rows = [(i, " ".join(w[i:] + w[:i]), None) for i in range(len(w))] + [(90, "słowo " * 3000, None)]
    got = {r[0]: r[2] for r in canonical.mapped(frame(spark, "answer_id long, category string, subcategory string", rows), tax).collect()}
    assert got == {i: 1 for i in range(len(w))} | {90: -1}


# 3 ---------------------------------------------------------------------------------

def words(seed, n=120):
    rng = np.random.default_rng(seed)
    return [f"w{int(x)}x" for x in rng.integers(0, 4000, n)]


def test_agreement():
    a = words(1)
    b = a[:60] + ["changed"] * 12 + a[72:]
    assert batchdedup.agreement(" ".join(a), " ".join(b)) == pytest.approx(0.9, abs=0.02)
    assert batchdedup.agreement(" ".join(a), " ".join(words(2))) < 0.2
    assert batchdedup.agreement(" ".join("文书合同仓库设备电力"), " ".join("文书合同仓库设备电力")) == 1.0


def test_batches_case_by_case(spark):
    base, other = " ".join(words(1)), " ".join(words(2))
    near = " ".join(words(1)[:110] + ["zzz"] * 10)
    far = " ".join(words(1)[:60] + words(3)[:60])
    chunk = "id long, file_id long, parent_id long, hierarchy string, type string, content_hash string, is_search boolean, contents string"
    import hashlib

    sha = hashlib.sha256(b"bytes").hexdigest()
    chunks = frame(spark, chunk, [(1, 100, 1, "parent", "text", sha.upper(), True, base), (2, 200, 200, "parent", "text", "", False, "x")])
    up = [(1, 200, b"q", [other]), (2, 300, b"bytes", [other]), (3, 301, b"a", [near.upper()]), (4, 302, b"b", [other]), (5, 303, b"b", ["no"]), (6, 302, b"c", ["new"]),
          (7, 300, b"d", ["new too"]), (8, 304, b"e", [far]), (9, 305, b"f", [""]), (10, 306, None, None), (11, 307, b"g", [other + "\n\n" + " "]), (12, 301, b"h", ["totally other words here now"])]
    uploads = frame(spark, "seq long, file_id long, content binary, pages array<string>", up)
    got = {r[0]: (r[1], r[2]) for r in batchdedup.repeats(uploads, chunks).collect()}
    assert got == {1: ("id", 200), 2: ("bytes", 100), 3: ("near", 100), 5: ("bytes", 302), 6: ("id", 302), 7: ("id", 300), 11: ("near", 302)}
    assert batchdedup.repeats(uploads.where("false"), chunks).count() == 0


def test_batches_family_over_range(spark, monkeypatch):
    """A family larger than a block: each copy meets the stored file, or the one upload that is accepted."""
    monkeypatch.setattr(batchdedup, "RANGE", 4)
    base, other = words(1), words(5)

    def copy(text, i, n=6):
        return " ".join(text[:10 * (i % 11)] + [f"n{i}q{j}" for j in range(n)] + text[10 * (i % 11) + n:])

    chunks = frame(spark, "id long, file_id long, parent_id long, hierarchy string, type string, content_hash string, is_search boolean, contents string",
                   [(1, 100006, 1, "parent", "text", "", True, " ".join(base)), (2, 400, 400, "parent", "text", "", False, "x")])
    up = [(i, 1000 + i, b"a%d" % i, [copy(base, i)]) for i in range(1, 16)]
    up += [(20, 400, b"b20", [" ".join(other)])]  # an id: it accepts nothing, though all below agree with it
    up += [(20 + i, 2000 + i, b"b%d" % i, [copy(other, i)]) for i in range(1, 7)]
    uploads = frame(spark, "seq long, file_id long, content binary, pages array<string>", up)
    got = {r[0]: (r[1], r[2]) for r in batchdedup.repeats(uploads, chunks).collect()}
    want = {i: ("near", 100006) for i in range(1, 16)} | {20: ("id", 400)} | {20 + i: ("near", 2001) for i in range(2, 7)}
    assert got == want


CHUNK = "id long, file_id long, parent_id long, hierarchy string, type string, content_hash string, is_search boolean, contents string"


def chain_uploads():
    """Near copies in chains, so that each upload hangs on the one before, with repeats of files and bytes among them."""
    up, seq = [], 0
    for c in range(4):
        text = words(300 + c, 100)
        for step in range(7):
            seq += 1
            text = text[:14 * step] + [f"c{c}s{step}n{j}" for j in range(14)] + text[14 * step + 14:]
            up.append((seq, 1000 + seq, b"x%d" % seq, [" ".join(text)]))
    up += [(seq + 1, 1003, b"new", ["anything else at all"]), (seq + 2, 2000, b"x5", ["some words here"]), (seq + 3, 2001, None, None)]
    return up


def brute_repeats(uploads, stored):
    """One upload after the other, by the definition."""
    import hashlib

    norm = lambda pages: "\n".join(" ".join(batchdedup.tokens(p)) for p in (pages or []) if batchdedup.tokens(p))
    files, shas, texts, out = {f for f, _ in stored}, {}, [(f, norm([t])) for f, t in stored], {}
    for seq, file_id, content, pages in sorted(uploads):
        sha, text = content and hashlib.sha256(content).hexdigest(), norm(pages)
        near = [(-batchdedup.agreement(text, t), i, f) for i, (f, t) in enumerate(texts) if text and t and batchdedup.agreement(text, t) >= 0.8]
        if file_id in files:
            out[seq] = ("id", file_id)
        elif sha in shas:
            out[seq] = ("bytes", shas[sha])
            files.add(file_id)
        elif near:
            out[seq] = ("near", min(near)[2])
        else:
            files.add(file_id)
            if sha:
                shas[sha] = file_id
            texts.append((file_id, text))
    return out


@pytest.mark.parametrize("last", [200_000, 0])
def test_chains_equal_one_by_one(spark, monkeypatch, last):
    monkeypatch.setattr(batchdedup, "LAST_UPLOADS", last)
    stored = [(500, " ".join(words(301, 100)))]
    chunks = frame(spark, CHUNK, [(1, 500, 1, "parent", "text", "", True, stored[0][1])])
    up = chain_uploads()
    got = {r[0]: (r[1], r[2]) for r in batchdedup.repeats(frame(spark, "seq long, file_id long, content binary, pages array<string>", up), chunks).collect()}
    want = brute_repeats(up, stored)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and got == want


def test_forest_takes_batches_without_the_history(spark, tmp_path, monkeypatch):
    """Batch by batch against the kept forest gives what all at once gives, though no stored text can be read again."""
    monkeypatch.setattr(batchdedup, "MAX_RUNS", 1)
    stored = [(500 + i, " ".join(words(400 + i, 90))) for i in range(6)]
    chunks = frame(spark, CHUNK, [(i, f, 1, "parent", "text", "", True, t) for i, (f, t) in enumerate(stored)])
    up = chain_uploads() + [(100 + i, 3000 + i, b"s%d" % i, [t.upper() + " extra"]) for i, (_, t) in enumerate(stored)]
    schema = "seq long, file_id long, content binary, pages array<string>"
    want = {r[0]: (r[1], r[2]) for r in batchdedup.repeats(frame(spark, schema, up), chunks).collect()}
    forest = batchdedup.indexed(chunks, batchdedup.Forest(spark, str(tmp_path / "forest")))
    unread = chunks.selectExpr(*[c for c in chunks.columns if c != "contents"], "assert_true(false) is null as b").selectExpr(*[c for c in chunks.columns if c != "contents"], "cast(b as string) as contents")
    got = {}
    for part in (up[:9], up[9:20], up[20:]):
        got |= {r[0]: (r[1], r[2]) for r in batchdedup.repeats(frame(spark, schema, part), unread, forest, accept=True).collect()}
        assert len(forest._parts("keys")) == 1  # merged
    assert got == want
    run = forest.runs()[0]
    rows = spark.read.parquet(run.files[0][0]).collect()
    assert [(r.tree, r.key, r.id) for r in rows] == sorted((r.tree, r.key, r.id) for r in rows)


def test_prefixes_widen_until_the_recall():
    assert batchdedup.depths(0.8, 0.7) == (4,) and batchdedup.depths(0.8, 0.95) == (4, 3) and batchdedup.depths(0.8, 0.999) == (4, 3, 2)


def test_large_file_ids_keep_their_value(spark):
    big = (1 << 61) + 1
    chunks = frame(spark, CHUNK, [(1, big, 1, "parent", "text", "", True, " ".join(words(7)))])
    up = frame(spark, "seq long, file_id long, content binary, pages array<string>", [(1, 5, b"a", [" ".join(words(7)[:-3])])])
    assert [tuple(r) for r in batchdedup.repeats(up, chunks).collect()] == [(1, "near", big)]


def scattered(seed, tokens, share, alphabet):
    """The tokens with a share of them, picked at random, replaced by others."""
    rng = np.random.default_rng(seed)
    out = list(tokens)
    for i in rng.choice(len(out), int(len(out) * share), replace=False):
        out[i] = alphabet[int(rng.integers(len(alphabet)))]
    return out


HAN, THAI = [chr(0x4E00 + i) for i in range(900)], [chr(0x0E01 + i) for i in range(46)]


def share_a_tree(a, b, depth=3):
    memo = batchdedup._Hashes()
    keys = [{(t, k >> 16 * (4 - depth)) for t, k in zip(*(v.tolist() for v in batchdedup.signature([x], memo)[:2]))} for x in (a, b)]
    return bool(keys[0] & keys[1])


def worth_comparing(a, b):
    memo = batchdedup._Hashes()
    return batchdedup.worth_comparing(*(batchdedup.signature([x], memo)[2] for x in (a, b)))


def test_unspaced_scripts():
    rng = np.random.default_rng(2)
    met = thai = 0
    for i in range(60):
        alphabet = (HAN, THAI)[i % 2]
        a = [alphabet[int(x)] for x in rng.integers(0, len(alphabet), 150 + 8 * i)]
        b = scattered(i, a, 0.15, alphabet)
        assert batchdedup.agreement(" ".join(a), " ".join(b)) >= 0.8
        assert batchdedup.agreement(" ".join(a), " ".join(scattered(i, a, 0.3, alphabet))) < 0.8
        half = len(a) // 2
        moved = " ".join(b[half:]) + "\n" + " ".join(b[:half])
        assert batchdedup.agreement(" ".join(a[:half]) + "\n" + " ".join(a[half:]), moved) >= 0.8
        if alphabet is HAN:
            met += share_a_tree(a, scattered(i, a, 0.2, alphabet))
        else:
            thai += share_a_tree(a, scattered(i, a, 0.12, alphabet), depth=2)
        assert worth_comparing(a, scattered(i, a, 0.2, alphabet))
    assert met >= 28 and thai >= 28


def test_short_texts_meet():
    for n in (10, 20, 40, 80, 240):
        met = 0
        for i in range(100):
            a = words(i, n)
            b = scattered(i, a, 0.2, [f"other{j}" for j in range(999)])
            met += share_a_tree(a, b, depth=4) and worth_comparing(a, b)
        assert met >= 95


# 4 ---------------------------------------------------------------------------------

def test_pii_shapes_and_masks():
    text = "Kontakt: jan.kowal@poczta.example lub tel. +48 100 200 300, ul. Wierzbowa 5 m. 3, 00-123 Tymianki. Profil @warsztat, wersja 10.0.0.7."
    spans = pii.mentions(text, pii.Learned.nothing())
    assert [(text[a:b], k) for a, b, k in spans] == [("jan.kowal@poczta.example", "EMAIL"), ("+48 100 200 300", "PHONE"), ("ul. Wierzbowa 5 m. 3, 00-123 Tymianki", "ADDRESS")]
    masked = pii.mask(text, spans)
    assert masked == "Kontakt: [EMAIL] lub tel. [PHONE], [ADDRESS]. Profil @warsztat, wersja 10.0.0.7."
    assert pii.mentions("", pii.Learned.nothing()) == []


def test_pii_learns_patterns(spark):
    rows = [(i, f"Prosimy dzwonić pod +48 10{i} 20{i} 30{i}. Koniec.", "x") for i in range(8)]
    rows += [(50, "Prosimy dzwonić pod 101 202 303. Koniec.", "x"), (51, "Kwota wynosi 101 202 303 zł.", "x"), (52, None, "x"), (53, "", "x")]
    rows += [(60 + i, "Mr. Rowan Sterling wrote.", "x") for i in range(12)] + [(90, "Signed by Rowan Vellex in May.", "x")]
    df = frame(spark, "id long, contents string, pattern string", rows)
    got = pii.extracted(df).collect()
    text = {r[0]: r[1] for r in rows}
    found = {(r[0], text[r[0]][r[1]:r[2]], r[3]) for r in got}
    assert (50, "101 202 303", "PHONE") in found and not any(f[0] == 51 for f in found)
    assert (60, "Rowan Sterling", "NAME") in found and (90, "Rowan Vellex", "NAME") in found
    assert pii.extracted(df.where("false")).count() == 0


def test_pii_rare_patterns_count_in_any_table(spark):
    """A label met a few times finds its numbers, whatever share of all mentions it has."""
    rows = [(i, f"Prosimy dzwonić pod +48 10{i} 20{i} 30{i}. Koniec.") for i in range(8)] + [(50, "Prosimy dzwonić pod 101 202 303. Koniec.")]
    rows += [(1000 + i, " ".join(f"Wyraz{i}x{j} Drugi{j}y{i}." for j in range(40))) for i in range(400)]
    got = {r[0] for r in pii.extracted(frame(spark, "id long, contents string", rows)).where("pii_type = 'PHONE'").collect()}
    assert got == {*range(8), 50}


def test_masking_survives_repeated_rows(spark):
    df = frame(spark, "id long, contents string", [(1, "abc def"), (1, "abc def"), (2, None)])
    spans = frame(spark, "id long, span_start int, span_end int, pii_type string", [(1, 0, 7, "NAME"), (1, 0, 7, "NAME")])
    assert sorted((r[0], r[1]) for r in pii.masked(df, spans).collect() if r[0] == 1) == [(1, "[NAME]"), (1, "[NAME]")]


def test_small_names_beside_letters_that_change_length(spark):
    rows = [(i, "Mr. Rowan Sterling wrote.") for i in range(12)] + [(50 + i, f"Signed by Rowan Vel{'abcdefgh'[i]}x in May.") for i in range(8)] + [(90, "İ. Signed by rowan vellex in May.")]
    found = {(r[0], r[1]) for r in pii.extracted(frame(spark, "id long, contents string", rows)).collect()}
    assert (90, 13) in found


# 5 ---------------------------------------------------------------------------------

def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x[700:900] = x[:200] + rng.normal(size=(200, 64)).astype(np.float32) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i < j}
    got = set()
    for p, q, _ in neighbors.Graph(x).build(0.9).pairs:
        got |= {(min(a, b), max(a, b)) for a, b in zip(p.tolist(), q.tolist())}
    assert len(got & want) >= 0.95 * len(want) and got <= want
    ids, sims = neighbors.Graph(x).build().search(x[:50], 20)
    assert (ids[:, 0] == np.arange(50)).mean() > 0.9 and neighbors.Graph(x[:1]).build().search(x[:1], 4)[0][0, 0] == 0


def test_similar_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 64))
    x[60:90] = x[:30] + rng.normal(size=(30, 64)) * 0.15
    x[90:110] = x[90]  # twenty copies
    rows = [(i, [float(v) for v in x[i] * (1 + i % 3)]) for i in range(120)]
    rows += [(200, None), (201, [0.0] * 64), (202, [float("nan")] * 64), (203, [1.0] * 32), (204, [float("inf")] * 64)]
    df = frame(spark, "id long, dense_embedding array<float>", rows).selectExpr("*", "1 AS v")
    got = {(r[0], r[1]) for r in neighbors.similar(df.select("id", "dense_embedding")).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 5)
    np.fill_diagonal(s, -1)
    top = {i: [j for j in sorted(range(120), key=lambda j: (-s[i, j], j)) if s[i, j] >= 0.9][:10] for i in range(120)}
    want = {(i, j) for i in top for j in top[i] if i < j and i in top[j]}
    assert got == want
    assert neighbors.similar(df.select("id", "dense_embedding").where("false")).count() == 0


def test_graphs_are_stored_and_read_back():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbors.Graph(x).build()
    again = neighbors.Graph.stored(x, *g.arrays())
    for a, b in zip(g.search(x[:80], 20), again.search(x[:80], 20)):
        assert np.array_equal(a, b)


def test_large_shards_are_split(spark):
    """All vectors in one dense region, near copies in threes: parts of about the limit, and no near copies lost between them."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + np.tile(rng.normal(size=(100, 64)) * 0.35, (3, 1)) + rng.normal(size=(300, 64)) * 0.03
    df = frame(spark, "id long, dense_embedding array<float>", [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    vectors, copies = neighbors._copies(neighbors.usable(df), 10)
    centres = neighbors.pivots(vectors)
    assert len(centres) == 1
    rows = neighbors.split(neighbors.routed(vectors, centres), 100)
    sizes = [r["count"] for r in rows.where("owner").groupBy("shard", "sub").count().collect()]
    assert sum(sizes) == 300 and len(sizes) == 3 and max(sizes) < 150
    whole = {tuple(r) for r in neighbors.mutual(neighbors.similar_pairs(vectors, centres), copies).collect()}
    parts = {tuple(r) for r in neighbors.mutual(neighbors.similar_pairs(vectors, centres, limit=100), copies).collect()}
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 100 == j % 100}
    assert near <= whole and near <= parts and len(whole & parts) >= 0.8 * len(whole | parts)


# 6 ---------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n。é", max_size=200), st.integers(5, 40), st.integers(0, 10))
def test_split_round_trip(text, limit, overlap):
    pieces_ = splitting.split(text, limit, min(overlap, limit - 1))
    if len(text) <= limit:
        assert len(pieces_) == (1 if text else 0)
        return
    assert "".join(text[n:e] for _, n, e, _ in pieces_) == text
    for i, (s, n, e, level) in enumerate(pieces_):
        assert s <= n < e and e - s <= limit and n - s <= overlap
    longest = max(map(len, re.split(r"[\s.!?…。！？؟।።։]", text)))
    assert (longest > limit) == any(p[3] == splitting.FORCED for p in pieces_)


def test_split_frame(spark):
    df = frame(spark, "id long, parent_id long, hierarchy string, contents string, piece string", [(1, 2, "parent", "word. " * 400, "x"), (2, 2, "parent", None, "x"), (3, 2, "parent", "", "x"), (4, 2, "parent", "z" * 1600, "x")])
    got = splitting.split_oversized(df).collect()
    assert {r.id for r in got} == {1, 4} and max(len(r.piece) for r in got) <= 1500
    assert {(r[0], r[1]) for r in splitting.kinds(df).collect()} == {(1, "natural"), (4, "forced")}


# 7 ---------------------------------------------------------------------------------

def longest_match_brute(stream, sequences, end):
    best = 0
    for s in sequences:
        for i in range(len(s)):
            k = 0
            while k <= end and k <= i and stream[end - k] == s[i - k]:
                k += 1
            best = max(best, k)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4), st.lists(st.sampled_from("abcd"), max_size=25))
def test_automaton_runs(sequences, stream):
    auto = leakage.Automaton(sequences)
    ends = {(e - 1): n for e, n, _ in auto.runs(stream, 1)}
    for e, n in ends.items():
        assert longest_match_brute(stream, sequences, e) == n
    for e, n, state in auto.runs(stream, 1):
        spots = auto.occurrences(state)
        assert spots and all(sequences[i][p - n + 1: p + 1] == stream[e - n: e] for i, p in spots)
        assert len(spots) == sum(s[i: i + n] == stream[e - n: e] for s in sequences for i in range(len(s) - n + 1))


def test_leak_cases(spark):
    item = " ".join(words(11, 60))
    w = item.split()
    docs = [(1, "intro " + item.upper() + " end"), (2, " ".join(words(12, 300))), (3, "pre " + " ".join(w[:40]) + " post"), (4, " ".join(w[:15]) + " only"),
            (5, " ".join(x if i % 4 else x[:2] + "q" + x[2:] for i, x in enumerate(w))), (6, " ".join(w[:3] + [w[3][:3] + "-\n" + w[3][3:]] + w[4:])), (7, None), (8, ""),
            (9, " ".join(reversed(w))), (10, "<b>" + "</b> <i>".join(w) + "</i>")]
    d = frame(spark, "doc_id long, text string", docs).selectExpr("*", "7 AS item_id")
    items = frame(spark, "item_id long, text string", [(70, item), (71, item.title()), (72, None), (73, "")])
    got = {(r[0], r[1]) for r in leakage.leaked(d, items).collect()}
    assert got == {(x, i) for x in (1, 3, 5, 6, 10) for i in (70, 71)}
    assert leakage.leaked(d, items.where("false")).count() == 0 and leakage.leaked(d.where("false"), items).count() == 0


def test_leaked_spans_are_removed(spark):
    item = " ".join(words(11, 60))
    w = item.split()
    before, after = prose(21, 4), prose(22, 4)
    docs = [(1, f"{before} {item.upper()} {after}"), (2, f"{before}\n<b>{' '.join(w[5:45])}</b> {after}"), (3, before), (4, None), (5, f"{item}. {before} {item}")]
    d = frame(spark, "doc_id long, text string", docs)
    items = frame(spark, "item_id long, text string", [(70, item)])
    spans = leakage.spans(d, items)
    text = dict(docs)
    got = sorted((r[0], text[r[0]][r[2]:r[3]].lower()) for r in spans.collect())
    assert got == [(1, item), (2, " ".join(w[5:45])), (5, item), (5, item)]
    clean = {r[0]: r[1] for r in leakage.cleaned(d, spans).collect()}
    assert clean == {1: f"{before}  {after}", 2: f"{before}\n<b></b> {after}", 3: before, 4: None, 5: f". {before} "}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB<&;-\n é漢字ł1.", max_size=60))
def test_located_tokens_are_the_text_s(text):
    toks, places = leakage.located(text)
    assert len(toks) == len(places) and all(0 <= a < b <= len(text) for a, b in places)


# 8 ---------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(0, 300))
def test_fit_is_best(hist, budget):
    lengths, counts = list(hist), list(hist.values())
    take = mixing.fit(lengths, counts, budget, exact=10_000)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    sums = {0}
    for n, c in hist.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * t for n, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_mix(spark):
    docs = frame(spark, "doc_id long, source string, text string", [(i, " A " if i % 2 else "b", "word " * (1 + i % 7)) for i in range(80)] + [(900, None, "x y"), (901, "zz", "x"), (902, "a", None)])
    targets = frame(spark, "source string, target_share double, max_repeats int", [("a", 0.8, 2), ("b", 0.1, 1), ("c", 0.1, 3)])
    size = {r.source: r for r in mixing.shares(mixing.sized(docs, targets), targets).collect()}
    assert not size["a"].misses and not size["b"].misses and size["c"].misses and size["c"].size == 0
    sizes = mixing.sized(docs, targets)
    assert {r.source: r.short for r in mixing.fitted(sizes, targets).collect()} == {r.source: r.misses for r in mixing.shares(sizes, targets).collect()}
    tight = frame(spark, "source string, target_share double, max_repeats int", [("a", 0.1, 1), ("b", 0.9, 1)])
    assert {r.source for r in mixing.fitted(mixing.sized(docs, tight), tight).where("short").collect()} == {"b"}
    with pytest.raises(Exception, match="listed twice"):
        mixing.shares(sizes, targets.unionByName(targets)).collect()
    rows = mixing.mix(docs, targets).collect()
    used = Counter()
    for r in rows:
        assert r.times <= (2 if r.source == "a" else 1)
        used[r.source] += r.tokens * r.times
    assert len({r.doc_id for r in rows}) == len(rows)
    for s in ("a", "b"):
        assert 0 <= size[s].budget - used[s] <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, targets).collect()))
    assert not any(r.misses for r in mixing.shares(mixing.sized(docs.where("false"), targets), targets).collect())


# 9 ---------------------------------------------------------------------------------

def prose(seed, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = [f"{'bcdfgklmnprst'[a]}{'aeiou'[b]}{'bdgklmnrst'[c]}{'aeo'[e]}n" for a, b, c, e in zip(rng.integers(0, 13, 8), rng.integers(0, 5, 8), rng.integers(0, 10, 8), rng.integers(0, 3, 8))]
        out.append(f"The {w[0]} of the {w[1]} is {w[2]} to a {w[3]} with {w[4]} and {w[5]} for the {w[6]} {w[7]}.")
    return " ".join(out)


def test_spam_cases(spark):
    rows = [(i, prose(i)) for i in range(30)]
    rows += [(100, "buy cheap shoes " * 150), (101, " ".join(f"#tag{i % 5}" for i in range(300))), (102, "\n".join(f"https://www.site-{i}.example/tag/x.html" for i in range(120))),
             (103, prose(99) + " " + "shoes cheap " * 20), (104, None), (105, ""), (106, "   ")]
    df = frame(spark, "doc_id long, text string", rows).selectExpr("*", "1 AS k")
    got = {r.doc_id for r in spam.scored(df).where("abnormal > 0.5").collect()}
    assert got == {100, 101, 102}
    assert spam.scored(df.where("false")).count() == 0


def test_spam_verdict_does_not_depend_on_the_size():
    """The same documents 1, 10, 100 and 1,000 times over give one verdict each, repeated classes included."""
    texts = [prose(i) for i in range(60)] + [prose(70) + " shoes" * 3 + " " + prose(71)]
    tests = {"stuffed": "buy cheap shoes " * 150, "one word": "shoes " * 300, "pairs": "alpha beta gamma delta " * 90, "tags": " ".join(f"#tag{i % 5}" for i in range(300)), "prose": prose(99)}
    base = sum(spam._window_counts(spam.classes(t)[0]) for t in texts).reshape(2, *[spam.CLASSES] * 3).astype(float)
    verdicts = []
    for times in (1, 10, 100, 1000):
        model = spam._log_model(base * times)
        scores = np.concatenate([spam._window_scores(spam.classes(t)[0], model)[3] for t in texts])
        lo, mid, hi = np.quantile(scores, (0.1587, 0.5, 0.8413))
        spread = max((hi - lo) / 2, 0.02)
        limits = np.array([[mid - spam.LOW_SPREADS * spread, mid + spam.HIGH_SPREADS * spread]] * 2)
        row = {}
        for name, t in tests.items():
            w, comp, script, score = spam._window_scores(spam.classes(t)[0], model)
            row[name] = bool(spam._abnormal(comp, script, score, limits).mean() > 0.5)
        verdicts.append(row)
    assert all(v == {"stuffed": True, "one word": True, "pairs": True, "tags": True, "prose": False} for v in verdicts), verdicts


def test_spam_few_tokens(spark):
    df = frame(spark, "doc_id long, text string", [(1, "word"), (2, "two words")] + [(10 + i, prose(i)) for i in range(10)])
    assert {r.doc_id for r in spam.scored(df).where("abnormal > 0.5").collect()} == set()


def test_long_tokens_keep_their_length(spark):
    df = frame(spark, "doc_id long, text string", [(1, "short " + "x" * 4000 + " words")])
    row = spam.encoded(df, "doc_id", "text").first()
    lengths = np.frombuffer(row["n"], dtype=np.int32)
    assert len(lengths) == len(row["k"]) and lengths.max() >= 4000


def test_classes_mark_recurrence():
    k, n = spam.classes("alpha beta alpha alpha")
    assert list(k) == [spam.KIND["new"], spam.KIND["new"], spam.KIND["again"], spam.KIND["often"]] and list(n) == [5, 4, 5, 5]
    assert len(spam.classes("")[0]) == 0
