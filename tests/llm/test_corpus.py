"""The corpus operators against brute force, round trips and odd rows."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import classifier, decontamination, graph, host_rules, licenses, mixing, ngram_join, ngram_lm, paragraph_dedup, pii, queries, warc

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an be ca do el fi go ha in jo ke la mi no or pa qu re su ta un vi we xy za".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with results."""
    r = random.Random(3)
    rows = [(1, prose(r, 40), "en", "a", 9), (1, prose(random.Random(3), 40), "en", "a", 9), (2, None, None, None, None), (None, "alone a@b.co", "en", "a", 1), (None, None, None, None, None)]
    rows += [(3, "", "en", "b", 0), (4, " \t\n", "en", "b", 3), (5, "word", "en", "b", 4), (6, "x " * 60_000, "en", "a", 120_000), (7, "y" * 200_000, "en", "a", 200_000), (8, prose(r, 60), "en", "c", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = "_id _t _i _x _e _row row score predicted size place taken shards target rank block words take shard kept n_words base_failed component component_id node text_hash _text"
    return df.withColumns({n: F.lit(1) for n in names.split()})


def test_odd_rows_do_not_crash_and_all_come_back(spark):
    docs = odd(spark)
    n = docs.count()
    assert pii.personal_data(docs).count() == n
    clean = pii.sanitised(docs)
    assert clean.count() == n and clean.columns == docs.columns
    assert {r.text for r in clean.where("doc_id is null").collect()} == {None, "alone [email]"}
    assert host_rules.host_quality_rules(docs).count() == n
    assert ngram_join.jaccard_components(docs).count() == n
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, prose(random.Random(3), 40))], "item_id long, text string")
    assert {r.id for r in decontamination.contaminated(docs, bench).collect()} == {1}
    assert decontamination.decontaminated(docs, bench).count() == n - 2
    assert mixing.mix(mixing.sized(docs)).count() == n
    assert mixing.mixed_documents(docs).count() > 0
    assert licenses.scan_licenses(docs.withColumn("path", F.col("source"))).count() == n
    repeats = paragraph_dedup.repeated_paragraphs(docs)
    assert repeats.where("removed").count() == 0
    assert paragraph_dedup.without_repeats(docs).columns == docs.columns
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (5, None), (3, 7)], "doc_id long, quality int")
    assert classifier.with_quality_scores(docs, classifier.train(docs, labels)).count() == n
    scored = ngram_lm.with_lm_scores(docs, F.col("doc_id") < 7)
    assert scored.count() == n and scored.where("score is null or score > 0").count() == 0


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        pii.personal_data(docs), pii.sanitised(docs), host_rules.host_quality_rules(docs), ngram_join.jaccard_components(docs), decontamination.contaminated(docs, bench), decontamination.decontaminated(docs, bench),
        mixing.mix(mixing.sized(docs)), mixing.mixed_documents(docs), licenses.scan_licenses(docs.withColumn("path", F.col("source"))), paragraph_dedup.repeated_paragraphs(docs),
        classifier.with_quality_scores(docs, classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int"))),
        ngram_lm.with_lm_scores(docs, F.lit(True)),
    ):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(pages, f"{ngram_join_folder(spark)}/none").count() == 0


def ngram_join_folder(spark):
    from plumbline.llm.common import shared_folder

    return shared_folder(spark)


def test_pipeline_stages_take_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.collect()


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from plumbline.llm.common import shared_folder

    def session(master, conf=None):
        context = SimpleNamespace(getConf=lambda: conf or {}, master=master, applicationId=master)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))

    assert shared_folder(session("local[4]")) == shared_folder(session("local[4]")) and shared_folder(session("yarn", {"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="share"):
            shared_folder(session(master))


def loop_dual(rows, labels, cost):
    """The hinge loss dual of ratio-scaled indicators, solved by many more passes over dense vectors."""
    size = 1 << 6
    counts = [np.ones(size), np.ones(size)]
    for ids, y in zip(rows, labels):
        counts[int(y)][ids] += 1
    ratio = np.log(counts[1] / (labels.sum() + 2)) - np.log(counts[0] / ((1 - labels).sum() + 2))
    x = np.zeros((len(rows), size))
    for i, ids in enumerate(rows):
        x[i, ids] = ratio[ids] / np.sqrt(len(ids))
    y = 2 * labels - 1
    a = np.zeros(len(rows))
    for _ in range(3000):
        for i in range(len(rows)):
            a[i] = np.clip(a[i] + (1 - y[i] * x[i] @ (x.T @ (a * y))) / (x[i] @ x[i]), 0, cost)
    return x @ (x.T @ (a * y)), x, ratio


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(classifier, "PASSES", 400)
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 40, 9) + 24 * (i % 2)) for i in range(40)]
    labels = np.array([i % 2 if i % 7 else 1 - i % 2 for i in range(40)], float)
    want, x, ratio = loop_dual(rows, labels, 0.5)
    w, bias = classifier.fit_weights(rows, labels, 6, cost=0.5)
    got = np.array([w[ids].sum() / np.sqrt(len(ids)) for ids in rows])
    assert bias == 0 and np.abs(got - want).max() < 0.02


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_regexes(spark):
    r = random.Random(11)
    pieces = ["a", "Z9", "@", ".", "-", "+", "(", ")", " ", "4", "1", "0", "255", "256", "é", "😀", "%", "4539578763621486", "+1 (555) 010-9999", "1.2.3.4", "x@y.zz", "007.1.1.1"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(400)]
    docs = documents(spark, texts)
    got = {x.doc_id: x.base for x in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        for kind, p in PATTERNS.items():
            want = [(m.start(), m.end()) for m in re.finditer(p, t) if passes(kind, m.group())]
            assert [(s.start, s.end) for s in got[i][kind]] == want, (kind, t)


def test_texts_of_many_spans(spark):
    mails = " ".join(f"user{i}@mail{i % 50}.example.org" for i in range(3_000))
    got = pii.personal_data(documents(spark, [mails, "none", "a@b.co"])).collect()
    assert sorted(len(x.base.email) for x in got) == [0, 1, 3_000]
    spans = max((x.base.email for x in got), key=len)
    assert all(mails[s.start : s.end] == s.value for s in spans)


def test_terms_that_go_with_an_entity_disclose_it(spark):
    r = random.Random(5)
    texts = [f"{prose(r, 20)} ask Zorblatt at zor@mail.com {prose(r, 20)}" for _ in range(8)] + [prose(r, 40) for _ in range(200)]
    docs = documents(spark, texts)
    rows = {x.doc_id: x for x in pii.personal_data(docs).collect()}
    for i in range(8):
        terms = {texts[i][s.start : s.end] for s in rows[i].terms}
        assert "Zorblatt" in terms and len(terms) < 6
    assert not any(rows[i].terms for i in range(8, 208))
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert all("Zorblatt" not in clean[i] and "zor@" not in clean[i] and "[email]" in clean[i] for i in range(8))
    assert all(clean[i] == texts[i] for i in range(8, 208))


def test_disclosing_terms_go_wherever_they_stand(spark):
    r = random.Random(15)
    texts = [f"Zorblatt {prose(r, 60)} zor@mail.com {prose(r, 20)}" for _ in range(8)]
    texts += [f"{prose(r, 30)} zorblatt, {prose(r, 10)}"] + [prose(r, 40) for _ in range(200)]
    docs = documents(spark, texts)
    rows = {x.doc_id: x for x in pii.personal_data(docs).collect()}
    assert all("zorblatt" in {texts[i][s.start : s.end].lower() for s in rows[i].terms} for i in range(9))
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert all("zorblatt" not in clean[i].lower() for i in range(9)) and all("[email]" in clean[i] for i in range(8))
    # words of chance may tell the address too
    assert sum(clean[i] == texts[i] for i in range(9, 209)) > 150


def test_questions_with_other_numbers_are_caught(spark):
    r = random.Random(2)
    item = "A train leaves Paris with 120 riders and after 3 hours it has gone 240 km how many km is that in 1 hour for 120 riders"
    texts = [
        prose(r, 30) + " " + item.replace("120", "77").replace("240", "300").replace("Paris", "Rome") + " " + prose(r, 30),
        prose(r, 10) + " " + item.replace("with 120", "with 77").replace("3 hours", "9 hours") + " " + prose(r, 9),
        prose(r, 80),
        item.lower() + " " + prose(r, 5),
        item,
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.id: x for x in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert 0 in got and not got[0].verbatim and got[4].verbatim and 2 not in got
    assert (got[1].n_slots, got[1].n_agreeing) == (10, 8), "120 is asked as 77 and as 120: two fillings of ten"
    assert got[3].verbatim, "a copy in lower case"
    assert {x.doc_id for x in decontamination.decontaminated(documents(spark, texts), bench).collect()} == {2}


def test_copies_of_any_case_and_of_items_full_of_slots_are_caught(spark, monkeypatch):
    r = random.Random(12)
    plain = prose(r, 40)
    slots = "Ada Bell 12 met Cid Dorn 34 near Elm Fort 56 Gale Hull 78"
    texts = [prose(r, 20) + " " + plain.upper() + " " + prose(r, 20), prose(r, 9) + " " + slots.lower(), slots, "Abe Cole 13 met Dan Eddy 35 near Fox Gulf 57 Hale Ives 79", prose(r, 60), plain + " " + slots]
    bench = spark.createDataFrame([(1, plain), (2, slots)], "item_id long, text string")
    find = lambda: {(x.id, x.item_id, x.verbatim) for x in decontamination.contaminated(documents(spark, texts), bench).collect()}
    want = {(0, 1, True), (1, 2, True), (2, 2, True), (5, 1, True), (5, 2, True)}
    assert find() == want
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert find() == want


def loop_targets(sizes, weights, share, repeats):
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / w >= repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            total -= out[i]
            open_.remove(i)
    return out


def test_targets_equal_repeated_resharing(spark):
    r = random.Random(4)
    for n in (1, 2, 7, 20):
        sizes = [r.choice([0, 5, 100, 5000, 10**6]) + r.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [x.target for x in mixing.targets(df).orderBy("source").collect()]
        want = loop_targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(n)], 1.5, 2)
        assert got == pytest.approx(want)


def test_mix_takes_its_targets_exactly_and_shards_are_even(spark):
    r = random.Random(9)
    docs = documents(spark, [prose(r, r.randint(0, 80)) for _ in range(600)], ("a", "a", "b", "c", None))
    first = mixing.mix(mixing.sized(docs)).collect()
    again = mixing.mix(mixing.sized(docs.repartition(7))).collect()
    assert {x.doc_id: (x.taken, x.shards) for x in first} == {x.doc_id: (x.taken, x.shards) for x in again}
    by = collections.defaultdict(list)
    for x in first:
        by[x.source].append(x)
        assert 0 <= x.taken <= 2 * x.size
    for rows in by.values():
        assert sum(x.taken for x in rows) == round(rows[0].target) and sum(x.size for x in rows) == rows[0].source_size
    takes = mixing.mixed_documents(docs)
    assert takes.agg(F.sum("words")).first()[0] == sum(x.taken for x in first)
    assert takes.where("words <> size(filter(split(text, ' '), x -> x <> ''))").count() == 0


def test_splitting_tree_deals_even_shards_of_exact_quotas(spark):
    q = [700, 3, 0, 41, 256]
    ends = {x["rank"]: x.ends for x in mixing.splitting_tree(spark.createDataFrame(list(enumerate(q)), "rank int, quota long")).collect()}
    shares = {k: np.diff([0, *v]) for k, v in ends.items()}
    assert all(sum(shares[k]) == q[k] and min(shares[k]) >= 0 for k in shares)
    totals = sum(shares.values())
    assert sum(totals) == 1000 and max(totals) - min(totals) <= 1
    assert all(abs(x - 700 / 8) < 30 for x in shares[0])


def test_repeated_passages_are_found_wherever_they_stand(spark):
    r = random.Random(8)
    passages = [prose(r, n) for n in (50, 55, 90)]
    texts = [prose(r, r.randint(10, 120)) for _ in range(40)]
    holders = {k: r.sample(range(40), 3) for k in range(3)}
    for k, ids in holders.items():
        for i in ids:
            texts[i] = f"{texts[i]}\n{prose(r, 13)} {passages[k]} {prose(r, 17)}"
    texts.append(f"{passages[0]} {prose(r, 30)} {passages[0]}")
    docs = documents(spark, texts)
    got = paragraph_dedup.repeated_paragraphs(docs).collect()
    assert {x.doc_id for x in got} == {i for ids in holders.values() for i in ids} | {40}
    kept = collections.Counter(x.cluster_id for x in got if not x.removed)
    assert set(kept.values()) == {1}
    gone = {x.doc_id: x.text for x in paragraph_dedup.without_repeats(docs).collect()}
    assert all(len(gone[i].split()) <= len(texts[i].split()) for i in gone)
    # all but the ends of a removed passage goes: less than a stretch at each
    for k, ids in holders.items():
        for i in sorted(ids)[1:]:
            assert len(texts[i].split()) - len(gone[i].split()) >= len(passages[k].split()) - 2 * (paragraph_dedup.STRETCH - 1)


def near_pairs(texts):
    """Pairs of whole texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_near_paragraphs_are_found_at_every_length(spark):
    r = random.Random(77)
    texts, length = [], {}
    for n in (20, 25, 30, 40, 60, 100):
        for k in range(14):
            base = prose(r, n).split()
            for copy in range(3):
                own = list(base)
                if copy:
                    own[(0, n - 1, r.randrange(n))[(k + copy) % 3]] = f"other{len(texts)}"
                length[len(texts)] = n
                texts.append(" ".join(own))
    wanted = near_pairs(texts)
    cluster = {x.doc_id: x.cluster_id for x in paragraph_dedup.repeated_paragraphs(documents(spark, texts)).collect() if x.unit == "line"}
    for n in set(length.values()):
        pairs = [(i, j) for i, j in wanted if length[i] == n]
        assert len(pairs) > 10 and sum(i in cluster and cluster.get(i) == cluster.get(j) for i, j in pairs) >= 0.9 * len(pairs), n
    # nothing else is linked: clusters hold together by near pairs
    linked = {i for p in wanted for i in p}
    assert set(cluster) <= linked


def test_two_texts_of_one_id_are_two_documents(spark):
    r = random.Random(78)
    passage, own, other = prose(r, 60), prose(r, 120), prose(r, 90)
    docs = spark.createDataFrame([(1, f"{prose(r, 30)} {passage}"), (2, f"{other} {passage}"), (2, own)], "doc_id long, text string")
    left = paragraph_dedup.without_repeats(docs).collect()
    assert own in [x.text for x in left]
    assert any(x.text.startswith(other[:200]) and len(x.text.split()) < 120 for x in left)


def test_near_paragraphs_join_a_cluster(spark):
    r = random.Random(12)
    base = prose(r, 200).split()
    other = list(base)
    other[100] = "changed"
    got = paragraph_dedup.repeated_paragraphs(documents(spark, [" ".join(base), " ".join(other), prose(r, 200)])).collect()
    assert {x.doc_id for x in got} == {0, 1}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5000, 5000 + i) for i in range(1, 400)] + [(7000 - i, 7001 - i) for i in range(700)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    table = spark.createDataFrame(edges, "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(table, max_rounds=2)
    got = {x.node: x.component for x in graph.components(table).collect()}
    assert got == {x: root(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def loop_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("few, block, entries, columns", [(64, 512, 1 << 21, 4096), (3, 7, 1 << 21, 50), (3, 512, 900, 4096)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, few, block, entries, columns):
    for name, value in (("FEW", few), ("BLOCK", block), ("ENTRIES", entries), ("COLUMNS", columns)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(21)
    texts = [None, "", "One two", "one TWO", "É b c d", "é b c d"]
    shared = prose(r, 30)
    for _ in range(14):
        base = prose(r, r.choice([6, 30, 120, 700])).split()
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 60))):
                copy[r.randrange(len(copy))] = word(r)
            texts.append(" ".join(copy))
        texts.append(shared + " " + prose(r, 10))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == loop_components(texts)


def test_overlaps_equal_intersections(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, n)) for n in (1, 40, 90, 200, 3, 60)]
    some = np.array([1, 3])
    got = ngram_join.overlaps(sets, some)
    assert all(got[k, j] == len(np.intersect1d(sets[i], x)) for k, i in enumerate(some) for j, x in enumerate(sets) if i != j)
    assert ngram_join.overlaps([np.array([5]), np.array([7])], np.arange(2)).tolist() == [[0, 0], [0, 0]]


def test_a_group_of_near_copies_is_not_paired_block_by_block(spark, monkeypatch):
    """Copies that are linked with the lead are compared in one block each, however many there are; the others are still found."""
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    r = random.Random(31)
    base = prose(r, 60).split()
    copies = [" ".join([*base[:59], f"{word(r)}{i}"]) for i in range(1500)]
    folder = ngram_join_folder(spark).removeprefix("file://")

    def leftovers():
        return [d for _, names, _ in os.walk(folder) for d in names if "-again" in d]

    before = leftovers()
    got = collections.Counter(x.component_id for x in ngram_join.jaccard_components(documents(spark, [*copies, prose(r, 60)])).collect())
    assert got == {0: 1500, 1500: 1} and leftovers() == before
    for i in range(0, 300):
        copy = list(base)
        copy[r.randrange(60)] = f"{word(r)}{i}"
        copies[i] = " ".join(copy)
    texts = copies[:500]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(documents(spark, texts)).collect()} == loop_components(texts)
    assert len(leftovers()) > len(before)


def test_parity_never_overstates_the_difference():
    r = np.random.default_rng(0)
    for n in (10, 400, 3000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 9], r.integers(0, 2**63, n // 7).astype(np.uint64)]))
        assert ngram_join.least_difference(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (300, 310), (2000, 10**9), (5000, 6000)):
        v = np.sort(r.integers(0, top, n))
        ef = ngram_lm.EliasFano.build(v)
        assert (ef.get(np.arange(n)) == v).all()
        x = r.integers(0, top + 10, 4000)
        assert (ef.successor(x, np.zeros(4000, np.int64), np.full(4000, n)) == np.searchsorted(v, x)).all()
        begin = r.integers(0, n + 1, 4000)
        end = begin + r.integers(0, n + 1 - begin)
        assert (ef.successor(x, begin, end) == np.clip(np.searchsorted(v, x), begin, end)).all()


def test_trie_finds_what_a_dictionary_does():
    r = np.random.default_rng(2)
    size = 500
    v = np.minimum((r.pareto(1.0, 6000)).astype(np.int64), size - 1)  # some contexts have most of the words
    pairs = np.unique(v * size + r.integers(0, size, 6000))
    triples = np.unique(r.integers(0, len(pairs), 9000) * size + r.integers(0, size, 9000))
    values = {k: -r.random(m) for k, m in (("p1", size), ("b1", size), ("p2", len(pairs)), ("b2", len(pairs)), ("p3", len(triples)))}
    trie = ngram_lm.Trie.mapped(ngram_lm.Trie.pack({2: (size, *np.divmod(pairs, size)), 3: (len(pairs), *np.divmod(triples, size))}, values))
    for level, known, above in ((2, pairs, size), (3, triples, len(pairs))):
        node = {int(k): i for i, k in enumerate(known)}
        asked = np.concatenate([known, r.integers(0, above * size, 9000)])
        assert trie.find(level, *np.divmod(asked, size)).tolist() == [node.get(int(k), -1) for k in asked]
        assert trie.find(level, np.full(3, -1), np.arange(3)).tolist() == [-1] * 3
    for name, x in values.items():
        assert np.abs(trie.value(name, np.arange(len(x))) - x).max() <= ngram_lm.STEP / 2 + 1e-12


@pytest.mark.parametrize("block, shard", [(1_000_000, 4_000_000), (300, 700)])
def test_language_model_equals_counted_probabilities(spark, monkeypatch, block, shard):
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    r = random.Random(6)
    vocabulary = [word(r) for _ in range(60)]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=r.randint(0, 60))).upper() for _ in range(300)]
    unseen = ["never seen " + texts[0], "", texts[7] + " É never"]
    got = {x.doc_id: x for x in ngram_lm.with_lm_scores(documents(spark, texts + unseen), F.col("doc_id") < 300).collect()}
    token = [t.replace("É", "é").lower().replace("é", "É").encode().split() + [b""] for t in texts + unseen]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for w in token[:300]:
        c1.update(w), c2.update(zip([b""] + w[:-1], w)), c3.update(zip([b""] + w[:-2], w[:-1], w[1:]) if len(w) > 1 else [])
    n, v = sum(c1.values()), len(c1)

    def weight(context, once):
        grid = [2.0**k for k in range(-4, 21)]
        return 2 ** np.interp(once, [sum(c * s / (c - 1 + s) for c in context.values()) for s in grid], np.log2(grid))

    s2, s3 = weight(c1, sum(c == 1 for c in c2.values())), weight(c2, sum(c == 1 for c in c3.values()))
    p1 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, w: (c2[a, w] + s2 * p1(w)) / (c1[a] + s2)
    p3 = lambda a, b, w: (c3[a, b, w] + s3 * p2(b, w)) / (c2[a, b] + s3)
    assert sum(p3(vocabulary[0].encode(), vocabulary[1].encode(), w) for w in c1) == pytest.approx(1 - p1(b"never") * s2 / (c1[vocabulary[1].encode()] + s2) * s3 / (c2[vocabulary[0].encode(), vocabulary[1].encode()] + s3))
    for i, w in enumerate(token):
        assert got[i].base_score == pytest.approx(sum(math.log10(p1(x)) for x in w))
        assert (got[i].n_known, got[i].n_tokens, got[i].train_tokens) == (sum(c1[x] > 0 for x in w), len(w), n)
        score = sum(math.log10(p2(b"", x) if k == 0 else p3(b"" if k == 1 else w[k - 2], w[k - 1], x)) for k, x in enumerate(w))
        assert got[i].score == pytest.approx(score, abs=1.5 * ngram_lm.STEP * len(w))  # up to three codes a token


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK", 400)
    monkeypatch.setattr(ngram_lm, "SHARD", 900)
    r = random.Random(9)
    vocabulary = [word(r) for _ in range(40)]
    docs = documents(spark, [" ".join(r.choices(vocabulary, k=r.randint(0, 50))) for _ in range(150)])
    scores = [{x.doc_id: x.score for x in ngram_lm.with_lm_scores(docs.repartition(n), F.col("doc_id") % 5 != 1).collect()} for n in (1, 6, 32)]
    for other in scores[1:]:
        assert other.keys() == scores[0].keys() and max(abs(other[i] - scores[0][i]) for i in other) < 1e-9


@tables
def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = [x for x in queries.QUERIES["op5_lm_scores"](spark, SF).collect() if x.held_out]
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 1) for x in rows)


def test_warc_round_trip(spark):
    r = random.Random(7)
    pages = [(i, f"http://h/{i}", f"<html>{prose(r, 200)}</html>") for i in range(120)]
    pages += [(200, "u", pages[3][2]), (201, None, pages[3][2]), (202, "u", None), (203, "u", ""), (None, "u", "lost"), (204, "u\r\nx", "é" * 50_000), (5, *pages[5][1:]), (205, "u", pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"{ngram_join_folder(spark)}/warc-test"
    manifest = warc.write_archives(df.repartition(3), folder, archive_bytes=60_000)
    assert manifest.count() > 3
    again = warc.write_archives(df, folder)  # a second set in the same folder is not read with the first
    assert again.count() >= 1
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i) if None not in (i, first.get(b, i)) else first.get(b, i)
    want = collections.Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[(h or "").encode()] == i else "revisit", None if first[(h or "").encode()] == i else first[(h or "").encode()]) for i, _, h in pages)
    assert collections.Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
    whole = {(x.page_id, bytes(x.payload)) for x in got if x.record_type == "response"}
    assert whole == {(i, (h or "").encode()) for i, _, h in pages if first[(h or "").encode()] == i}


def test_archives_lead_with_their_dictionary():
    r = random.Random(1)
    records = [warc.record(i, "u", prose(r, 150).encode(), 9, "00" * 20, None) for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and data[8:12] == (0xEC30A437).to_bytes(4, "little")
    assert list(warc.records_of(data)) == records and list(warc.records_of(warc.archive([b"x"]))) == [b"x"]


def test_small_and_uniform_archives_have_a_dictionary_too():
    r = random.Random(4)
    for records in ([b"x"], [b"", b""], [b"same record " * 40] * 3, [prose(r, 90_000).encode() for _ in range(3)], [bytes(8)], [(0xEC30A437).to_bytes(4, "little") + b"y" * 40]):
        data = warc.archive(records)
        size = int.from_bytes(data[4:8], "little")
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and (size > 0 or not any(records))
        assert list(warc.records_of(data)) == records


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    r = random.Random(2)
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "repo/LICENSE"),
        (2, prose(r, 30), "repo/src/a.py"),
        (3, "Released under the MIT License.", "repo/src/vendor/COPYING"),
        (4, prose(r, 30), "repo/src/vendor/lib/b.py"),
        (5, prose(r, 30) + "\nLicensed under CC BY-NC 4.0.\n" + prose(r, 30), "repo/src/vendor/c.txt"),
        (6, prose(r, 30), "elsewhere/d.py"),
        (7, prose(r, 30), None),
    ]
    got = {x.doc_id: (x.license, x.origin, x.license_dir) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[1][:2] == ("Apache-2.0", "file") and got[2] == ("Apache-2.0", "inherited", "repo/")
    assert got[4] == ("MIT", "inherited", "repo/src/vendor/") and got[5][:2] == ("CC-BY-NC-4.0", "header")
    assert got[6] == got[7] == (None, "none", None)


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_whole_licences_and_wrapped_headers_are_recognised(spark):
    r = random.Random(8)
    body = {name: [t for n, t, h in licenses.ALL_TEMPLATES if n == name and not h and len(t) > 120] for name in ("MIT", "GPL-3.0", "Apache-2.0")}
    mit = "MIT License\n\nCopyright (c) 2020 " + prose(r, 2) + "\n\n" + "\n\n".join(wrapped(t, 70) for t in body["MIT"])
    apache = "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n" + "\n\n".join(wrapped(prose(r, 60), 70) for _ in range(20))
    header = "# " + prose(r, 6) + "\n#\n" + wrapped(body["GPL-3.0"][0], 60, "# ") + "\n#\n\n" + wrapped(prose(r, 200), 70)
    rows = [(1, mit, "a/LICENSE"), (2, prose(r, 30), "a/b/c.py"), (3, apache, "d/LICENSE"), (4, prose(r, 30), "d/e.py"), (5, header, "f/g.py"), (6, prose(r, 30), "f/h.py")]
    got = {x.doc_id: (x.license, x.origin) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[1] == ("MIT", "file") and got[2] == ("MIT", "inherited")
    assert got[3] == ("Apache-2.0", "file") and got[4] == ("Apache-2.0", "inherited")
    assert got[5] == ("GPL-3.0", "header") and got[6] == (None, "none")


def test_licences_that_look_alike_are_told_apart(spark):
    text = {}
    for name, words in licenses.TEMPLATES:
        text.setdefault(name, []).append(words)
    bsd = [w for w in text["BSD-2-Clause"] if w.startswith(("Redistribution", "THIS SOFTWARE")) and not w.endswith("permitted")]
    third = next(w for w in text["BSD-3-Clause"] if w.startswith("Neither"))
    lgpl = next(w for w in text["LGPL-2.1"] if "version 2.1 of" in w)
    cases = {
        "LGPL-2.1": wrapped(lgpl, 70), "LGPL-3.0": wrapped(lgpl.replace("2.1", "3"), 70), "BSD-2-Clause": "\n\n".join(wrapped(w, 76) for w in bsd), "BSD-3-Clause": "\n\n".join(wrapped(w, 76) for w in [*bsd[:3], third, *bsd[3:]]),
        "CC0-1.0": "Creative Commons Legal Code\n\n" + wrapped(next(w for w in text["CC0-1.0"] if w.startswith("To the extent")), 72), "Unlicense": "\n\n".join(wrapped(w, 72) for w in text["Unlicense"][:2]),
        None: "Licensed under the Imaginary General Public License, version 9, of which nobody has heard in any jurisdiction",
    }
    rows = [(i, t, f"dir{i}/LICENSE") for i, t in enumerate(cases.values())]
    got = {x.doc_id: x.license for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(cases)


def test_host_verdicts_shrink_small_hosts(spark):
    r = random.Random(5)
    texts, hosts = [], []
    for h, n, bad in (("good", 40, 2), ("awful", 40, 40), ("tiny", 1, 1)):
        for i in range(n):
            texts.append(" ".join(f"{word(r)}$$$" for _ in range(30)) if i < bad else prose(r, 40))
            hosts.append(h)
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, hosts)), "doc_id long, text string, source string")
    got = {(x.source, x.host_passes) for x in host_rules.host_quality_rules(df).collect()}
    assert ("good", True) in got and ("awful", False) in got


def test_repeated_words_equal_a_loop(spark):
    r = random.Random(14)
    texts = []
    for _ in range(120):
        w = prose(r, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 3)):
            a = r.randrange(len(w) + 1)
            w[a:a] = w[r.randrange(len(w) + 1) :][: r.randint(0, 14)]
        texts.append(" ".join(w))
    got = {x.doc_id: x.n_repeat_words for x in host_rules.measure(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        assert got[i] == len({k + o for v in at.values() if len(v) > 1 for k in v for o in range(8)})


def test_classifier_tells_held_out_texts_apart(spark):
    r = random.Random(3)
    good, bad = [word(r) for _ in range(300)], [word(r) + "!!" for _ in range(300)]
    texts = [" ".join(r.choices(good if i % 2 else bad, k=r.randint(5, 60))) for i in range(400)]
    docs = documents(spark, texts).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    model = classifier.train(docs, labels.where("doc_id < 250"))
    got = classifier.with_quality_scores(docs.where("doc_id >= 250"), model).collect()
    assert sum(x.predicted == x.doc_id % 2 for x in got) / len(got) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    show = lambda v: "null" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(show, row)) for row in cur.fetchall())
    got = sorted(tuple(show(x[n]) for n in names) for x in queries.QUERIES[name](spark, SF).collect())
    assert got == want


@tables
def test_pipeline_stages_follow_from_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} <= {x.doc_id for x in docs.collect()}
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    texts = [x.text for x in sorted(docs.collect(), key=lambda x: x.doc_id)]
    ids = sorted(x.doc_id for x in docs.collect())
    groups = loop_components(texts)
    assert sorted(x.doc_id for x in kept) == sorted({ids[g] for _, g in groups.values()})
    assert sorted(map(str, out.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
