"""Quality rules, lexical search and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from popatlas.llm import lexical_search, merkle, quality_rules
from popatlas.llm.queries import QUERIES

WORDS = "alpha Beta gamma, delta. EPSILON zeta! eta 12 é ñandú #tag a|b <i> 漢字".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, s string, bag long, tree string"


def texts(seed, n):
    rng = random.Random(seed)
    made = [None, "", " \t\n", "one", "same " * 30, "x y z w v u t s " * 3, "long " * 20000 + "end"]
    for _ in range(n - len(made)):
        words = rng.choices(WORDS, k=rng.choice([3, 7, 8, 9, 15, 40, 200]))
        if rng.random() < 0.4:
            words += words[: rng.randrange(len(words)) + 1]
        made.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words))
    return made + made[7:20]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for number, text in enumerate(texts(3, 90)):
        lang = rng.choice(["en", "en", "en", "de", None, "é"])
        n = None if rng.random() < 0.1 else len(text or "")
        found.append((number, text, lang, rng.choice(["src", None]), n, "x", 7, "y"))
    found += [found[20], (None, "lost alpha", None, None, None, "x", 7, "y")] + [found[21]] * 3
    found.append((1 << 40, "ñandú", "en", "s", (1 << 63) - 1, None, None, None))
    rng.shuffle(found)
    return found


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# Quality rules


def plain_counts(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    tally, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if tally[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if word.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_statistics_are_those_of_the_whole_text(docs, rows):
    got = quality_rules.statistics(docs).select("doc_id", *quality_rules.COUNTS).collect()
    want = [(i, *plain_counts(text)) for i, text, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_statistics_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.statistics(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(quality_rules.statistics(none), labels) == []
    assert quality_rules.keep_good(none, []).columns == none.columns


def plain_best(rows):
    """The best condition by trying all: rows of (bad, shares by name)."""
    total, found = sum(bad for bad, _ in rows), []
    for feature in quality_rules.SHARES:
        for cut in {two_digits(shares[feature]) for _, shares in rows}:
            for at_least in (True, False):
                inside = [b for b, s in rows if (s[feature] >= cut) == at_least]
                if sum(inside):
                    p, before = sum(inside) / len(inside), total / len(rows)
                    gain = round(sum(inside) * (math.log2(p) - math.log2(before)), 6)
                    found.append((-gain, feature, not at_least, cut, sum(inside), len(inside) - sum(inside)))
    best = min(found, default=(0,))
    return best if best[0] < 0 else None


def two_digits(value):
    if value <= 0:
        return 0.0
    unit = 10.0 ** (math.floor(math.log10(value)) - 1)
    return round(math.floor(value / unit) * unit, 9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_condition_is_the_best_of_all(spark, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(200):
        shares = {f: rng.choice([0.0, rng.randrange(1, 400) / 64, 0.5]) for f in quality_rules.SHARES}
        bad = shares["repeat_share"] > 2 or rng.random() < 0.1
        data.append((bad, shares))
    kinds = ", ".join(f"{f} double" for f in quality_rules.SHARES)
    df = spark.createDataFrame([(b, *s.values()) for b, s in data], f"bad boolean, {kinds}")
    condition, bad, good = quality_rules.best_condition(df)
    _, feature, below, cut, want_bad, want_good = plain_best(data)
    assert (condition.feature, condition.at_least, bad, good) == (feature, not below, want_bad, want_good)
    assert condition.threshold == pytest.approx(cut)


def labelled(spark):
    """Shouting and symbol texts are bad, whatever their length; two ids are odd."""
    rng, docs, labels = random.Random(9), [], []
    for i in range(900):
        words = rng.choices("river stone light under many cold tall was".split(), k=rng.choice([25, 60, 300]))
        words = [f"{w}{rng.randrange(10**6)}" for w in words]
        kind = i % 6
        if kind == 0:
            words = [w.upper() for w in words]
        elif kind == 1:
            words = [w + rng.choice(["###", "&&"]) for w in words]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(kind > 1)))
    labels += [(None, 0), (3, None), (4, 7), (2, 1), (2, 1), (10**9, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_rules_are_learned_and_written_as_conditions(spark):
    docs, labels = labelled(spark)
    stats = quality_rules.statistics(docs)
    rules = quality_rules.learn(stats, labels)
    assert {rule.conditions[0].feature for rule in rules} == {"upper_share", "symbol_share"}
    for rule in rules:
        assert rule.bad >= 3 and rule.bad >= 0.9 * (rule.bad + rule.good)
    judged = quality_rules.judge(stats, rules).collect()
    assert all(r.kept == (r.doc_id % 6 > 1) for r in judged if not r.base_failed)
    held = [r for r in judged if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100
    # The same list by hand: the first rule that holds decides.
    by_id = {r.doc_id: r for r in stats.collect()}
    for r in judged:
        values = by_id[r.doc_id]
        hit = any(
            all((values[c.feature] >= c.threshold) == c.at_least for c in rule.conditions)
            for rule in rules
        )
        n, repeated = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert r.kept == (not r.base_failed and not hit)


def test_one_label_alone_or_none_gives_no_rules(spark):
    docs, labels = labelled(spark)
    stats = quality_rules.statistics(docs)
    assert quality_rules.learn(stats, labels.where("quality = 1")) == []
    assert quality_rules.learn(stats, labels.where("false")) == []


def test_keep_good_passes_all_columns_through(docs, rows):
    rule = quality_rules.Rule((quality_rules.Condition("symbol_share", True, 0.05),))
    kept = quality_rules.keep_good(docs, [rule])
    assert kept.dtypes == docs.dtypes
    want = []
    for row in rows:
        n, chars, symbols, _, repeated = plain_counts(row[1])
        if n >= 20 and 100 * repeated <= 30 * n and symbols / max(chars, 1) < 0.05:
            want.append(row)
    assert want and sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_the_registered_rules_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_quality_rules"](spark, sf).collect()
    want = {r.doc_id: plain_counts(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want and len(got) == len(want)
    assert not any(r.kept and r.base_failed for r in got)


# Lexical search


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    bags = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(term for _, bag, _ in bags for term in bag)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    found = []
    for item, terms in wanted.items():
        hits = []
        for doc, bag, n in bags:
            m, score = 50 + 50 * n * total // length, 0
            for term in terms & set(bag):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                score += w * (1000000000 * bag[term] // (1000 * bag[term] + 20 * m))
            if score > 0:
                hits.append((-score, doc is None, doc))
        best = sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k]
        found += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(best, 1)]
    return sorted(found, key=str)


ITEMS = [(1, "alpha BETA, gamma"), (2, "ñandú 漢字 é"), (2, "same one"), (3, None), (4, "..."), (None, "zeta eta 12"),
         (5, "absent"), (6, "end"), (6, "end")]


@pytest.mark.parametrize(("k", "block_terms"), [(50, 1000), (3, 4), (1, 1)])
def test_search_equals_brute_force(spark, docs, rows, k, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.search(docs, items, k=k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search([(i, t) for i, t, *_ in rows], ITEMS, k)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_takes_members_of_classes_by_id(spark):
    """Two classes of equal score interleave by id; a class is larger than k."""
    docs = [(i, "Apple pear" if i % 2 else "apple PLUM") for i in range(300)] + [(i, "fig nut") for i in range(300, 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "apple"), (2, "apple fig")]
    got = lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 50)
    assert [r.doc_id for r in got.where("item_id = 1").orderBy("rank").collect()] == list(range(50))


def test_search_over_nothing(spark, docs):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(docs.where("text is null"), items).count() == 0


def test_scores_are_exact_integers():
    postings = lexical_search.Postings([(0, 0), (1, 0), (1, 1)], 2, 2)
    postings.weights[:] = 40_000
    import numpy as np

    terms, rows = np.array([0, 1, 1]), np.array([0, 0, 1])
    tfs, m = np.array([10**9, 7, 123456789]), np.array([3, 10**9])
    got = postings.scores(rows, 2, terms, tfs, m)

    def worth(tf, m):
        return 40_000 * (10**9 * tf // (1000 * tf + 20 * m))

    a, b, c = worth(10**9, 3), worth(7, 3), worth(123456789, 10**9)
    assert got.tolist() == [[a + b, b], [c, c]]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, n):
    doc_id, text, lang, source, _, *_ = row

    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*map(framed, (doc_id, source, lang, n, text)))


def plain_climb(nodes, at):
    """(siblings with sides, root) of node ``at``."""
    steps = []
    while len(nodes) > 1:
        first = at - at % 2
        steps += [(x < at, nodes[x]) for x in range(first, min(first + 2, len(nodes))) if x != at] or [None]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at //= 2
    return steps, nodes[0]


def plain_fold(digest, steps):
    for step in steps:
        if step is None:
            digest = sha(digest)
        else:
            digest = sha(step[1], digest) if step[0] else sha(digest, step[1])
    return digest


def plain_manifest(rows):
    trees = {}
    for row in rows:
        doc_id, n = row[0], row[4]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        leaf, changed = plain_leaf(row, n), plain_leaf(row, n + 1 if hit else n)
        trees.setdefault(row[2], []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {lang: sorted(trees[lang], key=lambda x: x[:4]) for lang in langs}
    subroots = [plain_climb([x[2] for x in ordered[lang]], 0)[1] for lang in langs]
    found = []
    for number, lang in enumerate(langs):
        nodes = [x[2] for x in ordered[lang]]
        for at, (_, _, leaf, changed, doc_id) in enumerate(ordered[lang]):
            low, subroot = plain_climb(nodes, at)
            high, root = plain_climb(subroots, number)
            proof = sha(*[step[1] for step in low + high if step])
            folded = plain_fold(changed, low + high)
            found.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(found, key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(docs, rows, levels):
    got = sorted(map(tuple, merkle.manifest(docs, levels).collect()), key=str)
    want = plain_manifest(rows)
    assert got == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, docs):
    one = docs.where("doc_id = 9").limit(1)
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    assert merkle.manifest(docs.where("false")).count() == 0


def test_many_languages_make_a_tree_of_their_own(spark):
    rows = [(i, f"t{i}", f"l{i % 37}", None, i, None, None, None) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, merkle.manifest(df, 2).collect()), key=str) == plain_manifest(rows)


def test_a_fold_resumes_the_state_before_its_slot():
    leaves = [sha(str(i)) for i in range(11)]
    tree = merkle.Tree(leaves, 4)
    assert tree.root == plain_climb(leaves, 0)[1]
    for at in range(11):
        changed = [*leaves[:at], sha("new"), *leaves[at + 1 :]]
        assert tree.fold(at, sha("new")) == plain_climb(changed, 0)[1]
        assert tree.fold(at, leaves[at]) == tree.root
    # Each parent keeps one state per child, taken before that child was added.
    assert [len(s) for s in tree.states] == [11, 6, 3, 2]
    assert tree.states[0][1].hexdigest() == sha(leaves[0])


def test_sql_twins_of_search_and_manifest(spark):
    from checks.compare import connect, difference
    from popatlas.llm.queries import ORACLES

    con = connect("/root/testdata/sf0.001")
    for name in ("op12_lexical_search", "op13_merkle_manifest"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert difference(df, con, ORACLES[name]) is None
