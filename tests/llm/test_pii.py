import hashlib
import re

from pyspark.sql import functions as F

from tablejury.llm import pii

SF = "/root/testdata/sf0.01"
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
EDGE = ["", None, "a@b.c@d.e a@b.com_x@y.org", "1.2.3.4.5 01.002.255.0256 1.2.3.4.5.6.7.8 999.1.1.1",
        "é😀 4111 1111 1111 1111  4111-1111-1111-1111,4111111111111111-4111111111111111 0", "4111111111111111" * 3,
        "+1 (2) 345 6789) +1234567 +12 34 56 78 90 12 34 56 78 +1-2", "x@y@z.com foo.bar+baz@mail-1.example.co.uk. 😀a@b.cc",
        " ".join(f"u{i}@x{i}.com 10.0.{i % 256}.{i % 300}" for i in range(600)), "a" * 30_000 + "@" + "b." * 9000 + "c", "1" * 50_000]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(found, texts):
    assert len(found) == len(texts)
    for r in found:
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        base = [(k, int(s), int(e)) for k, s, e in spans if k != "term"]
        assert base == brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in KINDS]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string")
    check(pii.digest(pii.detect(docs)).collect(), dict(enumerate(EDGE)))
    real = spark.read.parquet(f"{SF}/documents.parquet")
    check(pii.digest(pii.detect(real)).collect(), {r.doc_id: r.text for r in real.collect()})


def corpus():
    """An entity named in seven texts, each with its code name; a common word; a copy repeated ten times."""
    rows = [(i, f"Code Zwiebelfisch belongs to boss@corp.example.org, matter {chr(97 + i) * 5}.") for i in range(7)]
    rows += [(10 + i, "The boss of another matter belongs elsewhere.") for i in range(20)]
    rows += [(40 + i, "Only Hapaxword knows lone@corp.example.org here.") for i in range(10)]
    return rows


def test_terms_that_reveal_an_entity(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r.doc_id: [(x.kind, x.value, x.tag) for x in r.pii] for r in pii.detect(docs).collect()}
    n, n_e = 37, 7
    assert found[0] == [("email", "boss@corp.example.org", "<EMAIL>"), ("term", "Code", ""), ("term", "Zwiebelfisch", "")]
    assert n > n_e and all(found[10 + i] == [] for i in range(20))  # the common words stay, and clean texts
    assert found[40] == [("email", "lone@corp.example.org", "<EMAIL>")]  # one text proves nothing, however often it is copied
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert clean[0].text == "  belongs to <EMAIL>, matter aaaaa." and clean[0].n_chars == len(clean[0].text)
    assert clean[12].text == dict(corpus())[12]


def test_share_is_pointwise_information_over_information_content(spark):
    import math

    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = {r.term: r.share for r in pii.revealing_terms(docs, share=0.0).collect()}
    n_t = {"zwiebelfisch": 7, "belongs": 27, "matter": 27}
    for term, count in n_t.items():
        assert abs(terms[term] - math.log2(7 * 37 / (7 * count)) / math.log2(37 / 7)) < 1e-12


def test_rare_entities_groups_and_short_terms(spark):
    """Two texts that name one entity, and two with addresses of one domain, are enough in a corpus of many others."""
    rows = [(i, f"Plain matter {chr(97 + i // 26) * 4}{chr(97 + i % 26) * 4} goes on.") for i in range(400)]
    rows += [(500, "Plain matter of Zwiebelfisch, agent X7: call +1 (076) 555-8046."), (501, "X7 goes on, so Zwiebelfisch: +1 076 555 8046 again.")]
    rows += [(502, "Plain Quastenflosser wrote to one@rare.example.org."), (503, "Quastenflosser goes on to two@rare.example.org.")]
    found = {r.doc_id: {x.value for x in r.pii if x.kind == "term"}
             for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[500] == found[501] == {"Zwiebelfisch", "X7"}
    assert found[502] == found[503] == {"Quastenflosser"}
    assert not any(found[i] for i in range(400))


def test_overlapping_spans_are_rewritten_once(spark):
    docs = spark.createDataFrame([(1, "x +14111111111111111 y a@1.2.3.4 z")], "doc_id long, text string")
    spans = brute("x +14111111111111111 y a@1.2.3.4 z")
    assert {s[0] for s in spans} >= {"email", "ip"}
    text = pii.sanitised(docs).first().text
    assert text.startswith("x ") and text.endswith("y <EMAIL> z")


def test_awkward_rows(awkward, empty):
    out = pii.sanitised(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert {r.pii for r in out.collect()} == {"p"} and {r.key for r in out.collect()} == {"k"}
    assert sum(r.text is None for r in out.collect()) == 2
    assert pii.sanitised(empty).count() == 0 and pii.detect(empty).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = pii.digest(pii.detect(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_that_are_no_terms_are_left_out_before_the_shuffle(spark, monkeypatch):
    """Also when the planner broadcasts no table: the words of a text meet the terms' buckets before they are counted and dealt out."""
    made, keep = {}, pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, purpose: made.setdefault(purpose, df) and keep(df, purpose))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = {(bytes(r.key), r.term, r.share) for r in pii.revealing_terms(docs).collect()}
    assert {t for _, t, _ in want} == {"code", "zwiebelfisch", "corp", "example"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made.clear()
        terms = pii.revealing_terms(docs)
        plan = made["pii-strong"]._jdf.queryExecution().optimizedPlan().toString().split("\n")
        monkeypatch.setattr(pii, "BUCKETS", 1)  # a filter that lets every word through
        for got in (terms, pii.revealing_terms(docs)):
            assert {(bytes(r.key), r.term, r.share) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert "LeftSemi" in next(line for line in reversed(plan[:words]) if "Aggregate" in line or "Join" in line)
