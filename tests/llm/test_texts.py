"""Personal information, leaks, mixtures and sentences."""

import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from codexlake.llm import leaks, mixing, privacy, sentences
from codexlake.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to a.b+c@uni-x.example.org today", {"email"}), ("nlind (at) library (dot) example (dot) com", {"email"}), ("kraken@5.2 rejects layer@2x.png", set()),
        ("call me on +44 (0)20 7946 0343", {"phone"}), ("mobile 07700 900 262 after six", {"phone"}), ("WhatsApp 202.555.0193", {"phone"}), ("Shelfmark 0305 91305 091 is not found", set()),
        ("ISBN 978-0-00-30080-8 in the field", set()), ("The date 2024-02-12 shows as 12.02.2024", set()), ("Job 607360 hangs at 10/73", set()), ("Since version 2.212.3", set()),
        ("979-30-5894 (social security) as proof", {"identity"}), ("Steuer-ID 00 924 432 120", {"identity"}), ("passport no. X22-60469 as proof", {"identity"}), ("National Insurance QQ 98 20 93 C", {"identity"}),
        ("DE89 3704 0044 0532 0130 00", {"identity"}), ("DE88 3704 0044 0532 0130 00", set()), ("card 4111 1111 1111 1111", {"identity"}),
        ("deliver to Flat 3, 195 Cooper's Yard, Froslune ZZ4 9QX please", {"address"}), ("our office, Klosterstraße 204, 01291 Draydorf, is closed", {"address"}), ("I live at 64 rue Neuve, 99502 Vellenau", {"address"}),
        ("Mill Lane psalter: folio 393v is upside down", set()), ("Room 24 in the library has no network", set()), ("send to P.O. Box 31, Tarnburg", {"address"}),
        ("my colleague Arman von Halbier saw it too", {"name"}), ("ok. Best, Zoe-Odile Tessstein", {"name"}), ("I am M. Fennidian and I correct folios", {"name"}), ("— Wexstein, Hugo", {"name"}),
        ("The Tessarion homilies and the Pellidor hymns are swapped", set()), ("I like the new keyboard", set()), ("St. Orvane's Acts, fols. 289–74, are paired wrongly", set()), ("", set()),
    ],
)
def test_kinds(text, kinds):
    spans = privacy.find_spans(text)
    assert {k for k, *_ in spans} == kinds
    assert all(p not in privacy.redact_text(text, spans) for p in [text[a:b] for _, a, b, _ in spans])


def test_routes_and_checks():
    assert privacy.scan_route("/share/to?name=Marek+Halbidian") == (["name"], "/share/to?name=[NAME]")
    assert privacy.scan_route("/members/hugo-morvopoulou")[0] == ["name"]
    assert privacy.scan_route("/projects/0f027f8b-88ad-4785-ac52-ef647ea63e59/documents?line=30&zoom=1.5")[0] == []
    assert privacy.scan_route("/p?x=1?tel=%2B44%207700%20900598")[0] == ["phone"] and privacy.scan_route("") == ([], "")
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112")
    assert privacy.mod97("GB82WEST12345698765432") and privacy.mod11_10("86095742719") and not privacy.mod11_10("86095742718")


def test_proposals_are_linear():
    for text in ("a." * 20_000, "a@" * 10_000, "1 " * 20_000, "Aa " * 20_000, "A. " * 20_000, "a at b dot " * 2_000):
        began = time.time()
        privacy.find_spans(text)
        assert time.time() - began < 8, text[:12]


def test_notes_edge_cases(spark, collected):
    long = "word " * 40_000 + "mail me: a@b.example"
    rows = [("1", "a@b.example", None, 5), ("1", "a@b.example", None, 5), ("2", None, "/invite/x.y@z.example", 5), ("3", "", "", 5), (None, "a@b.example", None, 5), ("4", long, None, 5)]
    df = spark.createDataFrame(rows, "id string, message string, page_path string, kinds int")
    found = privacy.personal_information(df).select("feedback_id", "field_name", "kind")
    assert collected(found) == [("1", "message", "email"), ("2", "page_path", "email"), ("4", "message", "email")]
    clean = {r.id: r.message for r in privacy.redacted_notes(df).collect() if r.id}
    assert clean["1"] == "[EMAIL]" and clean["2"] is None and clean["3"] == ""
    assert privacy.personal_information(df.limit(0)).count() == 0


def _leak_fixture():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(3, 10))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    passages = [(i, prose(60)) for i in range(40)]
    docs, true = [], set()
    for d in range(300):
        body = [prose(40) for _ in range(4)]
        if d % 3 == 0:
            i, p = passages[d % 40]
            letters = list(p[: int(len(p) * rng.choice([0.6, 0.8, 1.0]))])
            for _ in range(len(letters) // 40):
                letters[rng.randrange(len(letters))] = rng.choice("xyz")
            body.insert(2, "".join(letters).upper().replace(" ", "\n", 3))
            true.add((d, i))
        elif d % 3 == 1:
            body.insert(1, passages[d % 40][1][:90])
        docs.append((d, "\n\n".join(body)))
    return docs, passages, true


def test_leaks_equal_what_was_planted(spark, collected):
    docs, passages, true = _leak_fixture()
    extra = [(900, None), (901, ""), (902, "x" * 1_500_000 + passages[3][1] + "y" * 10), (None, passages[5][1])]
    df = spark.createDataFrame(docs + extra, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS term")
    items = spark.createDataFrame([*passages, passages[0], (77, None), (78, ""), (79, "short"), (None, "x" * 400)], "item_id bigint, passage string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, items).collect()}
    assert found == true | {(902, 3), (None, 5)}
    assert leaks.leaked_passages(df.limit(0), items).count() == 0 and leaks.leaked_passages(df, items.limit(0)).count() == 0


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 30)) * (rng.random((12, 30)) < 0.5)
    entries = spark.createDataFrame([(int(i), int(t), float(a[i, t])) for i, t in zip(*np.nonzero(a), strict=True)], "item int, term bigint, weight double")
    left, latent = leaks.randomised_svd(entries, 12, 12)
    right = a.T @ left
    assert np.allclose(right.T @ right, np.eye(right.shape[1]), atol=1e-6) and np.allclose(latent @ right.T, a, atol=1e-6)
    best, _ = leaks.randomised_svd(entries, 12, 4)
    assert best.shape == (12, 4) and leaks.randomised_svd(entries.limit(0), 3, 2)[0].shape == (3, 0)


def test_short_passages_and_blocks(spark, monkeypatch):
    """Passages from ten letters on are found, beside long ones and in blocks of passages."""
    rng = random.Random(11)
    made = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(n)) for n in (10, 14, 20, 26, 30, 33, 36, 48, 300, 500)]
    noise = ["".join(rng.choice("abcdefghilmnoprstuv ") for _ in range(700)) for _ in range(60)]
    docs = [(i, noise[i] + " " + p + " " + noise[i + 20]) for i, p in enumerate(made)] + [(100 + i, t) for i, t in enumerate(noise)]
    docs += [(200 + i, noise[i] + p[: int(len(p) * 0.6) + 1] + noise[i + 20]) for i, p in enumerate(made) if len(p) >= 30]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(made)), "item_id bigint, passage string")
    due = {(i, i) for i in range(len(made))} | {(200 + i, i) for i, p in enumerate(made) if len(p) >= 30}
    for block in (256, 4):
        monkeypatch.setattr(leaks, "BLOCK", block)
        found = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, items).collect()}
        assert due <= found and {i for _, i in found - due} <= {0, 1}


def test_wrong_letters_count_as_standing():
    a, b = (np.array([ord(c) for c in s], dtype=np.uint32) for s in ("abcdefghijkl", "abXdefgYYjkl"))
    assert leaks._common(a, b) == 9 and leaks._standing(a, b) == 10
    assert leaks._grown(a, b) == 7 and leaks._grown(a[:0], b) == 0


def test_paraphrases_need_the_latent_space(spark, monkeypatch):
    passage = "The careful scribe of Morhaven copied 12 psalms in the northern scriptorium before the winter, and the keeper Kallquist bound them in leather for the abbey library."
    told = "Before long the careful scribes of Morhaven copying 12 psalm in that northern scriptoria before winters and the keepers Kallquist bound them all in leathers for an abbey libraries."
    wrong = told.replace("Morhaven", "Tarnburg").replace("12", "40").replace("Kallquist", "Vogel")
    other = "The rapid seam explains the rubric with red ink and nobody knows why it was written in this smaller script at all."
    docs = spark.createDataFrame([(1, told), (2, wrong), (3, other), (4, None), (5, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (2, other)], "item_id bigint, passage string")
    assert [(r.doc_id, r.item_id) for r in leaks.paraphrased_passages(docs, items).orderBy("doc_id").collect()] == [(1, 1), (3, 2)]
    monkeypatch.setattr(leaks, "SAME_MEANING", 0.999)
    assert [r.doc_id for r in leaks.paraphrased_passages(docs, items).collect() if r.doc_id == 1] == []
    assert leaks.paraphrased_passages(docs.limit(0), items).count() == 0


def test_common_subsequence_equals_dynamic_programme():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, x=x, old=row: old[j - 1] + 1 if b[j - 1] == x else max(left, old[j]), initial=0))
        assert leaks._common(*(np.array([ord(c) for c in s], dtype=np.uint32) for s in (a, b))) == row[-1]


def test_pfair_keeps_every_source_within_a_block():
    for shares in ({"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1 / 7 for i in range(7)}, {"big": 0.97, "x": 0.02, "y": 0.01}):
        frame, counts = mixing.frame_counts(shares)
        plan = mixing.pfair_plan(counts)
        assert sum(counts.values()) == frame == len(plan)
        given = dict.fromkeys(counts, 0)
        for source, block, slot in plan:
            assert block == given[source]
            given[source] += 1
            assert all(abs(given[s] - counts[s] * (slot + 1) / frame) < 1 for s in counts)


def test_mixture_meets_shares_and_caps(spark, collected):
    rng = random.Random(3)
    tokens = [(i, rng.choice("aaab" if i % 9 else "c"), rng.randrange(50, 150)) for i in range(6000)] + [(None, "a", 5), (7001, None, 5), (7002, "a", None), (7003, "z", 10)]
    df = spark.createDataFrame(tokens, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 AS quota", "2 AS passes")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.2, 1), ("gone", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets).collect()
    whole = sum(r.n_tokens for r in m)
    for s, share, cap in (("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.2, 1)):
        assert abs(sum(r.n_tokens for r in m if r.source == s) / whole - share) < 0.003 and max(r.repeat for r in m if r.source == s) <= cap
    assert len({(r.doc_id, r.repeat, r.token_start) for r in m}) == len(m) and {r.source for r in m} == {"a", "b", "c"}
    report = {r.source: r for r in mixing.share_report(mixing.mix(df, targets), df, targets).collect()}
    assert report["gone"].actual_share == 0 and abs(report["b"].actual_share - 0.5) < 0.003
    forced = mixing.mix(df, targets, total_tokens=3 * whole).groupBy("source").max("repeat").collect()
    assert all(r[1] <= {"a": 2, "b": 3, "c": 1}[r.source] for r in forced)
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_running_deviation_in_tokens(spark):
    """After every slot each source is within one block of its share, however long its documents are."""
    docs = [(0, "long", 20_000), (1, "long", 3), (2, "long", 9_999)] + [(10 + i, "short", 700 + i) for i in range(60)] + [(100 + i, "mid", 4096) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    shares = {"long": 0.4, "short": 0.35, "mid": 0.25}
    targets = spark.createDataFrame([(s, w, 4) for s, w in shares.items()], "source string, target_share double, max_repeats int")
    rows = sorted(mixing.mix(df, targets).collect())
    given, seen, size = dict.fromkeys(shares, 0), defaultdict(list), {i: n for i, _, n in docs}
    for slot, pieces in itertools.groupby(rows, key=lambda r: r.slot):
        for r in pieces:
            assert r.slot_offset == sum(x.n_tokens for x in rows if x.slot == slot and x.slot_offset < r.slot_offset)
            given[r.source] += r.n_tokens
            seen[r.doc_id, r.repeat].append((r.token_start, r.n_tokens))
        assert all(abs(given[s] - w * mixing.BLOCK_TOKENS * (slot + 1)) < mixing.BLOCK_TOKENS + 1 for s, w in shares.items()) or slot > max(r.slot for r in rows) - 4
    assert all(abs(given[s] - w * sum(given.values())) <= 2 for s, w in shares.items())
    cut = [k for k, x in seen.items() if sum(n for _, n in x) != size[k[0]]]
    assert len(cut) <= len(shares) and all(a + n == b for x in seen.values() for (a, n), (b, _) in itertools.pairwise(sorted(x)))


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "text string")
    assert [r.n for r in df.select(mixing.count_tokens("text").alias("n")).collect()] == [3, 0, None]


SENTENCES = [
    ("Dr. M. Vogel came, e.g. at 10. Then he left! Really?! “Yes.” He said … no more.", ["Dr. M. Vogel came, e.g. at 10. Then he left!", "Really?!", "“Yes.”", "He said … no more."]),
    ("« Oui ! » dit-il. La fin…  Encore", ["« Oui ! » dit-il.", "La fin…", "Encore"]),
    ("Title\n\nOne line\nand its rest. 3.5 is less.\n31. The item follows.", ["Title", "One line\nand its rest. 3.5 is less.", "31. The item follows."]),
    ("Λόγος ἐστίν; ναί· ὄχι. Ἄλλο⁘ΝΕΟ", ["Λόγος ἐστίν; ναί· ὄχι.", "Ἄλλο⁘", "ΝΕΟ"]),
    ("Բառ. մէկ։ Երկու", ["Բառ. մէկ։", "Երկու"]),
    ("ܐܒ. ܓܕ܃ ܗ 3.5 ܘ؟ ܙ܀", ["ܐܒ.", "ܓܕ܃ ܗ 3.5 ܘ؟", "ܙ܀"]),
    ("ⲁⲃ·ⲅⲇ⳾ⲉ:ⲍ.ⲏ", ["ⲁⲃ·", "ⲅⲇ⳾", "ⲉ:ⲍ.", "ⲏ"]),
    ("他来了。她走了！「真的？」他问。", ["他来了。", "她走了！", "「真的？」", "他问。"]),
    ("यह एक है। वह दो है॥", ["यह एक है।", "वह दो है॥"]),
    ("ሰላም።እንዴት፧", ["ሰላም።", "እንዴት፧"]),
    ("see (ibid.). The next [sic!], and on. […] End", ["see (ibid.).", "The next [sic!], and on.", "[…] End"]),
]


def _trained(df):
    model, listed = sentences.train(df)
    model.decided = {r.key: r.score for r in listed.collect()}
    return model


def test_joined_scores_give_the_same_spans(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "Null id. Here."), (5, None), (6, "")], "doc_id bigint, text string"))
    sent = {tuple(r) for r in sentences.split_sentences(df).collect()}
    monkeypatch.setattr(sentences, "MAX_LISTED", 0)
    assert {tuple(r) for r in sentences.split_sentences(df).collect()} == sent


def test_scan_is_linear():
    model = sentences.Model(np.array([3.0, -8.0, *[0.0] * 10]), {})
    took = []
    for text in ("1. " * 30_000, "a.b" * 30_000, ". " * 40_000, "(" * 100_000, "x" * 200_000 + ". Y", " . \n" * 30_000):
        began = time.time()
        sentences.spans(text, model)
        sentences.open_keys(text)
        took.append(time.time() - began)
    assert max(took) < 3, took


def test_sentences_by_script(spark):
    corpus = ["He is here. The day ends. Dr. Who saw it. It was late.\n\nIt rained. Dr. No left, e.g. at 5. M. Roe came at night.\n\nThe end came. He saw Dr. Who again, e.g. now."] * 30
    texts = [t for t, _ in SENTENCES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + corpus)], "doc_id bigint, text string")
    model = _trained(df)
    for text, expected in SENTENCES:
        starts, ends = sentences.spans(text, model)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == expected


def test_spans_cover_all_text(spark, small):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "no stop"), (5, "Here is something. " * 30_000), (None, "Null id. Here.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS sent_start", "2 AS seen").unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "1 AS sent_start", "2 AS seen"))
    texts = {r.doc_id: r.text for r in df.collect()}
    found: dict = {}
    for r in sentences.split_sentences(df).collect():
        found.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert {1, 2, 3}.isdisjoint(found) and found[4] == [(0, 7)] and len(found[5]) == 30_000
    for doc, cuts in found.items():
        text, at = texts[doc], 0
        for a, b in sorted(cuts):
            assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() != ""
            at = b
        assert not text[at:].strip()
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_held_out_boundaries(spark, small):
    """The model, fitted on two thirds of the documents, settles held-out block ends as boundaries."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model = _trained(docs.where("doc_id % 3 <> 0"))
    right = seen = 0
    for r in docs.where("doc_id % 3 = 0").collect():
        blocks = [b for b in sentences._BLANK.split(r.text.strip()) if b]
        joined = " ".join(blocks)
        ends, at = set(sentences.spans(joined, model)[1]), 0
        for a, b in itertools.pairwise(blocks):
            at += len(a)
            if a[-1] in ".!?" and b[:1].isupper() and a[-2:-1].isalpha():
                seen += 1
                right += at in ends
            at += 1
    assert seen > 10 and right >= 0.97 * seen


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(name, spark, small):
    columns = {"p2_found": ["response_id", "line_id", "field_name"], "p3_found": ["feedback_id", "field_name", "kind"], "p4_found": ["row_id_a", "row_id_b"], "p5_found": ["row_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "sent_start", "sent_end"]}
    df = QUERIES[name](spark, small)
    assert df.columns == columns.get(name, df.columns)
    rows = df.count()
    assert rows > 0 and (name not in columns or df.distinct().count() == rows)
