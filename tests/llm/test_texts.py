import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shaleview.llm import codepoints as cp
from shaleview.llm import history, leakage, lookalikes, mixing, personal, scans

ODD = "aéß ​́ｘＡ　Аоα﻿ ж字😀\n-‐"


# ---- look-alikes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD) | st.characters(codec="utf-8"), max_size=30), max_size=8))
def test_explode_implode_round_trip(texts):
    assert cp.implode(*cp.explode(pa.array(texts, pa.string()))).to_pylist() == texts


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aeoucnAEO ̧́̀̈̃xy"), max_size=40))
def test_marks_compose_as_nfc(text):
    first = text.lstrip("̧́̀̈̃")
    got = cp.implode(*cp.unify(*cp.explode(pa.array([first])))).to_pylist()[0]
    # marks in canonical order compose fully; others keep their order
    if all(unicodedata.combining(a) <= unicodedata.combining(b) or not unicodedata.combining(b) for a, b in zip(first, first[1:])):
        assert unicodedata.normalize("NFC", got) == unicodedata.normalize("NFC", first)


def test_kinds(spark):
    rows = [(1, "ｆｕｌｌ"), (2, "é"), (3, "a­b"), (4, "a b"), (5, "Brаmen"), (6, "Москва é Ω series"), (7, None), (8, ""), (9, "слovo"), (10, "wo​rd"), (10, "wo​rd"), (11, "А clerk")]
    d = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id int, text string, char_kind string")
    got = {(r[0], r[1]) for r in lookalikes.char_kinds(d.select("doc_id", "text")).distinct().collect()}
    assert got == {(1, "fullwidth"), (2, "combining"), (3, "zero_width"), (4, "nbsp"), (5, "lookalike"), (9, "lookalike"), (10, "zero_width")}
    assert lookalikes.char_kinds(d).count() == len(got) + 1  # the repeated row; extra columns don't matter
    assert lookalikes.char_kinds(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_unified(spark):
    d = spark.createDataFrame([(1, "Ｃａｆé Brаmen​", 5), (2, None, 6), (3, "x" * 100_000, 7)], "doc_id int, text string, other int")
    got = {r.doc_id: (r.unified_text, r.other) for r in lookalikes.unified(d).collect()}
    assert got == {1: ("Café Bramen", 5), 2: (None, 6), 3: ("x" * 100_000, 7)}


# ---- leaks


def edit_substring(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, c in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p != c)))
        prev = cur
    return min(prev)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=90), st.integers(0, 4))
def test_myers(pattern, text, most):
    assert leakage.myers(pattern, text, most) == (edit_substring(pattern, text) <= most)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in ("re", "mor", "tal", "un", "ver", "sil") for b in ("den", "wick", "port", "ling", "stone", "by")] + ["of", "a", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + ".") for i in range(12)] + [(90, None), (91, ""), (92, "..."), (93, "short quote here")]
    docs = []
    for d in range(80):
        body = [rng.choice(vocab) for _ in range(60)]
        w = rng.choice(items[:12])[1].rstrip(".").split()
        n = rng.choice([0, 8, 11, 12, 13, 20, 40])
        at = rng.randrange(len(w) - n + 1)
        quote = w[at : at + n]
        text = " ".join(body[:30]) + " # " + (" ".join(quote) if d % 3 else ",\n".join(x.upper() for x in quote)) + " # " + " ".join(body[30:])
        docs.append((d, text.replace("den", "dеn") if d % 7 == 0 else text))
    docs += [(200, None), (201, ""), (202, "a Short, QUOTE\nhere!"), (203, docs[1][1])]
    squeeze = lambda t: [w for w in "".join(c if c.isalnum() or c.isspace() else " " for c in t.replace("е", "e").lower()).split()]
    want = set()
    for d, t in docs:
        for i, s in items:
            if not t or not s or not squeeze(s):
                continue
            a, b = squeeze(t), squeeze(s)
            n = min(12, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in grams for k in range(len(a) - n + 1)):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items + items[:2], "item_id int, text string")
    assert {tuple(r) for r in leakage.leaks(dd, ii, budget=0).collect()} == want
    assert {tuple(r) for r in leakage.leaks(dd, ii).collect()} >= want
    assert leakage.leaks(dd, ii.where("false")).count() == 0 and leakage.leaks(dd.where("false"), ii).count() == 0


def test_leak_with_slips(spark):
    words = "the night registrar of heskalcrest posted sixty laminated tally sheets beside weighbridge".split()
    item = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    hurt = " ".join(words).replace("laminated", "laminatod")
    d = spark.createDataFrame([(1, hurt), (2, " ".join(words[:11])), (3, " ".join(words[1:]))], "doc_id int, text string")
    assert {r.doc_id for r in leakage.leaks(d, item).collect()} == {1}


def test_short_item_leaves_the_budget_of_others(spark):
    words = "the night registrar of heskalcrest posted sixty laminated tally sheets beside weighbridge".split()
    small = "we go to an old inn in may as is our habit".split()  # 32 letters in twelve words
    item = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(small)), (3, "brief quotation here"), (4, "of it")], "item_id int, text string")
    slip = lambda w, *pairs: " ".join(dict(pairs).get(x, x) for x in w)
    rows = [(1, slip(words, ("laminated", "laminatod"))), (2, slip(words, ("laminated", "laminatod"), ("tally", "tallyy"))), (3, slip(words, ("laminated", "lomonotod"))),
            (4, slip(small[:12], ("old", "odd"), ("may", "mayy"))), (5, "a brief quotatiom here"), (6, "a brief quotutiom here"), (7, "af it"), (8, " ".join(words[:11])), (9, slip(words, ("sixty", "sixy"), ("tally", "taly")))]
    d = spark.createDataFrame([(k, f"quite other words come first and {t} and then some follow") for k, t in rows], "doc_id int, text string")
    assert {tuple(r) for r in leakage.leaks(d, item).collect()} == {(1, 1), (2, 1), (4, 2), (5, 3), (9, 1)}


# ---- history


def family(rng, n=70):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    rows, texts = [], {}
    for i in range(60):
        w = family(rng)
        rows.append((i, i % 5 + 1, " ".join(w)))
        for k in range(rng.choice([0, 0, 1, 2])):
            v = list(w)
            for _ in range(rng.choice([0, 2, 4, 30])):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + 10 * i + k, i % 5 + 1 + k, " ".join(v)))
    rows += [(9000, 3, None), (9001, 3, ""), (9002, 4, ""), (9003, 2, "same short"), (9004, 5, "Same, short!"), (9004, 5, "Same, short!")]
    pairs = {d: (r, {tuple(w) for w in zip(t.split(), t.split()[1:])}) for d, r, t in rows if t and d < 9000}
    want = {}
    for d, (r, p) in pairs.items():
        near = [(r2, d2) for d2, (r2, p2) in pairs.items() if d2 != d and r2 < r and len(p & p2) / len(p | p2) >= history.SIMILARITY]
        if near:
            want[d] = min(near)[1]
    want[9004] = 9003
    df = spark.createDataFrame(rows, "doc_id int, run_seq int, text string")
    got = dict(tuple(r)[::-1] for r in history.repeats(history.fingerprints(df)).collect())
    # families are led on to their root, so compare where the brute force knows the root itself
    assert set(got) == set(want) and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert history.repeats(history.fingerprints(df.where("false"))).count() == 0


def test_history_appends(spark, tmp_path):
    rng = random.Random(1)
    base = " ".join(family(rng))
    h = history.History(spark, f"file://{tmp_path}/h", 4)
    b = lambda *rows: spark.createDataFrame(rows, "doc_id int, run_seq int, text string")
    assert h.add(b((1, 1, base), (2, 1, "other words here"))).count() == 0
    assert {tuple(r) for r in h.add(b((3, 2, base.upper()), (4, 2, None))).collect()} == {(1, 3)}
    assert {tuple(r) for r in h.add(b((5, 3, base + " copy"), (6, 3, "quite new text"))).collect()} == {(1, 5)}
    assert h.index().count() == 4  # a row a content: the copy is no new one


def test_history_reopens_and_takes_a_batch_once(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(family(rng)) for _ in range(6)]
    b = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, run_seq int, text string, content string")
    path = f"file://{tmp_path}/h"
    history.History(spark, path, 4).add(b((1, 1, texts[0]), (2, 1, texts[1])), "one")
    again = history.History(spark, path)
    assert again.buckets == 4
    second = b((3, 2, texts[0] + " end"), (4, 2, texts[2]), (4, 2, texts[2]))
    assert {tuple(r) for r in again.add(second, "two").collect()} == {(1, 3)}
    # the same batch again: the same answer, nothing stored twice; a later batch meets it once
    assert {tuple(r) for r in history.History(spark, path).add(second, "two").collect()} == {(1, 3)}
    third = history.History(spark, path)
    assert third.index().count() == 4 and len(third.log()) == 2
    assert {tuple(r) for r in third.add(b((5, 3, texts[2].upper()), (6, 3, texts[5])), "three").collect()} == {(4, 5)}


def test_history_is_the_same_run_by_run_and_at_once(spark):
    rng = random.Random(8)
    base = [family(rng, 40) for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((i, i // 12, " ".join(w)))
    index = history.fingerprints(spark.createDataFrame(rows, "doc_id int, run_seq int, text string")).cache()
    one, all_ = ({tuple(r) for r in history.repeats(index, n, history.History(spark, None, 4)).collect()} for n in (4, 100))
    assert one == all_ and len(one) > 80


# ---- personal values


def test_values_and_placeholders(spark):
    people = [f"{r} {g} {s}, case handler." for g, s in zip(["Wanda", "Ivan", "Leila"] * 40, [f"{x}{y}" for x in ("Marl", "Gorm", "Vost", "Kess") for y in ("combe", "wick", "rigg")] * 10) for r in ("Signed,", "Patient")]
    text = "Dear Dr. Marlcombe, write to w.gorm+x at post dot example or a@b.test; call (206) 555-3618. Passport 891 93 5575; Invoice 309-82-7247. At 12 Oak Lane, by Ivan Kessrigg. Vostwick Foods waits."
    model = personal.corpus_model(spark.createDataFrame([(p,) for p in people], "text string"))
    got = [(text[a:b], k) for a, b, k in personal.values(text, model)]
    assert got == [("Marlcombe", "person_name"), ("w.gorm+x at post dot example", "email"), ("a@b.test", "email"), ("(206) 555-3618", "phone"), ("891 93 5575", "id_number"), ("12 Oak Lane", "street_address"), ("Ivan Kessrigg", "person_name")]
    d = spark.createDataFrame([("k", text, 1), ("n", None, 2), ("e", "", 3)], "log_id string, text string, pii_kind int")
    safe = {r.log_id: r.safe_text for r in personal.sanitised(d, "log_id", model=model).collect()}
    assert safe["n"] is None and safe["e"] == "" and "<EMAIL>" in safe["k"] and "a@b.test" not in safe["k"]
    assert personal.find(d, "log_id", model=model).count() == len(got)
    assert personal.find(d.where("false"), "log_id").count() == 0


@pytest.mark.parametrize("text", ["10.157.84.15", "c****x", "<EMAIL>", "REF-512952", "version 6.17.2", "The clinic on Oak Court closed"])
def test_no_values(text):
    assert personal.values(text, personal.Model([])) == []


def test_short_surnames_and_joined_terms(spark):
    first = ["Wanda", "Ivan", "Leila", "John"]
    people = [f"{r} {g} {s}, case handler." for g in first for s in ("Marlcombe", "Gormwick", "Smith", "Lee", "Brown") for r in ("Signed,", "Patient", "Dear")] * 2 + ["The Smith file was closed. We met in Boston and in Dover."] * 3
    texts = ["Patient John Smith called.", "Dear Ms. Brown, thank you.", "Signed, John Lee", "Contact J. Lee today.", "Dear Ivan Quay, hello", "", None, "Send it to Wanda in Dover."]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + people)], "log_id int, text string, kind string")
    own = lambda found: {(r.log_id, texts[r.log_id][r.start_pos : r.end_pos]) for r in found.where(f"log_id < {len(texts)}").collect()}
    want = {(0, "John Smith"), (1, "Brown"), (2, "John Lee"), (3, "J. Lee"), (4, "Ivan Quay"), (7, "Wanda")}
    assert own(personal.find(d, "log_id")) == want
    assert own(personal.find(d, "log_id", most=0)) == want  # each text joined with its own terms
    a, b = ({(r.log_id, r.safe_text) for r in personal.sanitised(d, "log_id", most=m).collect()} for m in (0, 10**6))
    assert a == b and (6, None) in a and (0, "Patient <PERSON_NAME> called.") in a


def test_cue_of_numbers_is_learned(spark):
    rows = [f"Steuernummer {i}23-45-678{i % 10} liegt vor." for i in range(9)] + ["Steuernummer 123456789 liegt vor. Regal 123456789 ist leer."] + [f"Regal {i}2345 ist leer." for i in range(9)]
    model = personal.corpus_model(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert [k for _, _, k in personal.values(rows[9], model)] == ["id_number"] and personal.values(rows[9], model)[0][0] == 13


def test_both_tables_are_sanitised(spark, tmp_path):
    spark.createDataFrame([(7, "Write to a@b.test today."), (8, None), (7, "Write to a@b.test today.")], "block_id long, text string").write.parquet(f"{tmp_path}/extracted_blocks.parquet")
    spark.createDataFrame([("k", "Call (206) 555-3618."), ("n", None)], "log_id string, prompt_text string").write.parquet(f"{tmp_path}/llm_call_logs.parquet")
    got = sorted((r.text_table, r.text_key, r.safe_text) for r in personal.p4_sanitised(spark, str(tmp_path)).collect())
    assert got == [("extracted_blocks", "7", "Write to <EMAIL> today."), ("extracted_blocks", "8", None), ("llm_call_logs", "k", "Call <PHONE>."), ("llm_call_logs", "n", None)]


# ---- scanned pages


@pytest.mark.parametrize(("clean", "seen", "n"), [("inform", "inforrn", 1), ("and", "ancl", 1), ("number", "niimber", 1), ("office", "of1cc", 0), ("select", "sclecf", 2), ("same", "same", 0), ("tall", "ta11", 2)])
def test_confusions(clean, seen, n):
    assert len(scans.confusions(clean, seen)) == n


@settings(max_examples=80, deadline=None)
@given(st.text("abcdeilmnoprstu", min_size=4, max_size=12), st.randoms())
def test_deletions_meet(word, rng):
    if scans.collapsed(word) != word:
        return
    hurt = list(word)
    for i in rng.sample(range(len(word)), min(2, len(word) // 2)):
        hurt[i] = scans.CONFUSIONS.get(hurt[i], [hurt[i]])[0]
    assert set(scans.deletions(word)) & set(scans.deletions("".join(hurt)))


def test_misreadings_are_judged_by_context_at_any_size(spark):
    line = "the training coordinator must mark the folder as restricted now"
    page = lambda i, t: (i, i, "prose", "\n".join([line] * 5 + [t]))
    for times in (1, 4):
        rows = [page(i, f"the cat was fed by hand {i}") for i in range(6 * times)] + [page(1000 + i, f"ask ted about it {i}") for i in range(30 * times)] + [page(2000 + i, "the tralning coordinator") for i in range(times)]
        d = spark.createDataFrame(rows, "block_id long, doc_id long, block_type string, text string")
        assert {r.block_id for r in scans.noise(d).where("noise_kind = 'characters'").collect()} == {2000 + i for i in range(times)}


def test_long_words_are_repaired(spark):
    word = "donaudampfschifffahrtsgesellschaftskapitan"
    line = f"the {word} must mark the folder now"
    d = spark.createDataFrame([(1, 1, "prose", "\n".join([line] * 9)), (2, 1, "prose", "\n".join([line] * 5 + [line.replace("kapitan", "kapltan")]))], "block_id long, doc_id long, block_type string, text string")
    assert {r.block_id for r in scans.noise(d).where("noise_kind = 'characters'").collect()} == {2}


def test_noise_and_repair(spark):
    line = "the training coordinator must mark the folder as restricted now"
    body = "\n".join([line] * 6)
    pages = [(i, 1, "prose", f"Acme Manual of Records\n{body}\nthis was page {'one two three four'.split()[i - 1]}.\nPage {i} of 9") for i in range(1, 4)]
    pages += [(4, 1, "prose", f"Acme Manual of Rec0rds\n{body}\nthe trainlng coordin-\nator and the cross-\nborder desk\n[4]"), (5, 2, "prose", "short text"), (6, 1, "table_cell", "x"), (7, 1, "prose", None), (4, 1, "prose", None)]
    d = spark.createDataFrame(pages + [(20 + i, 3, "prose", f"cross border {line} records manual") for i in range(4)], "block_id long, doc_id long, block_type string, text string")
    got = {}
    for r in scans.noise(d).collect():
        got.setdefault(r.block_id, set()).add(r.noise_kind)
    assert got == {1: {"running_header", "page_number"}, 2: {"running_header", "page_number"}, 3: {"running_header", "page_number"}, 4: {"running_header", "page_number", "hyphenation", "characters"}}
    fixed = {r.block_id: r.paragraphs for r in scans.repaired(d).collect()}
    assert fixed[1] == [" ".join([line] * 6) + " this was page one."] and fixed[4][0].endswith("the training coordinator and the cross-border desk")
    assert scans.noise(d.where("false")).count() == 0


# ---- mixing


def test_weights():
    shares, targets, most = np.array([0.6, 0.3, 0.1]), np.array([0.2, 0.3, 0.5]), np.array([60.0, 30.0, 40.0])
    w, x, total = mixing.limited_weights(shares, targets, most, None)
    assert x == 0 and np.allclose(w, targets) and total == pytest.approx(80)
    w, x, total = mixing.limited_weights(shares, targets, most, 95)
    assert 0 < x < 1 and total == pytest.approx(95) and (w * total <= most + 1e-6).all()
    w, x = mixing.entropy_weights(shares, 1.0)
    assert mixing.entropy(w) == pytest.approx(1.0, abs=1e-6)


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c"]), " ".join(["word"] * rng.randrange(1, 30)), 1) for i in range(400)] + [(900, None, "x", 1), (901, "a", None, 1), (902, "a", "", 1), (903, "zzz", "x", 1), (0, docs_source := "a", "again", 1)]
    del docs_source
    d = spark.createDataFrame(docs, "doc_id int, source string, text string, repeats int")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.15, 3), ("none", 0.05, 1)], "source string, target_weight double, max_repeats int")
    m = mixing.mixture(d, t, blocks=16).collect()
    size, limit = {}, {"a": 1, "b": 2, "c": 3}
    for r in m:
        assert 1 <= r.repeats <= limit[r.source]
        size[r.source] = size.get(r.source, 0) + r.n_tokens * r.repeats
    total, longest = sum(size.values()), 40
    assert len({r.doc_id for r in m}) == len(m) and all(abs(size[s] - w / 0.95 * total) <= 3 * longest for s, w in (("a", 0.4), ("b", 0.4), ("c", 0.15)))
    assert mixing.mixture(d.where("false"), t).count() == 0
    # as much as there is, which the targets don't allow: the exponent is bisected, so that the limits hold
    have = {r.source: r.n for r in mixing.sized(d.where("source in ('a', 'b', 'c')").dropDuplicates(["doc_id"])).groupBy("source").agg({"n_tokens": "sum"}).toDF("source", "n").collect()}
    m = mixing.mixture(d, t, blocks=16, total_tokens="all").collect()
    assert all(r.repeats <= limit[r.source] for r in m) and abs(sum(r.n_tokens * r.repeats for r in m) - sum(have.values())) <= 4 * longest
    # more than that no exponent up to 1 gives: the total is what the limits allow there
    m = mixing.mixture(d, t, blocks=16, total_tokens=2.0 * sum(have.values())).collect()
    assert all(r.repeats <= limit[r.source] for r in m) and abs(sum(r.n_tokens * r.repeats for r in m) - sum(have.values())) <= 4 * longest
    m = mixing.mixture(d, t, blocks=16, by_entropy=True).collect()
    size = {s: sum(r.n_tokens * r.repeats for r in m if r.source == s) for s in limit}
    w = np.array(list(size.values())) / sum(size.values())
    assert abs(mixing.entropy(w) - mixing.entropy(np.array([0.4, 0.4, 0.15, 0.05]))) < 0.1 or size["a"] > size["b"] > size["c"]
