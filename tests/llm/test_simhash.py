import random
import re

import pytest
from xxhash import xxh64_intdigest

from otindex.llm.components import components
from otindex.llm.simhash import crowded, deduplicate, fingerprint, near_duplicates, near_links

SCHEMA = "doc_id bigint, text string, fingerprint string, label long"


def brute_print(text, size=3, seed=42):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    shingles = [words[k : k + size] for k in range(max(1, len(words) - size + 1))]
    hashes = [xxh64_intdigest(" ".join(s).encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, seed=42):
    prints = [brute_print(t, 3, seed) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, *_), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return prints, [least.get(g) for g in group], group


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "ÀB", "x y"]
    base = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 300])) for _ in range(30)]
    texts = [" ".join(w) for w in base]
    for w in base[4:24]:
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("\t\n".join(w).upper().replace("Ü", "ü") if rng.random() < 0.3 else "  ".join(w))
    texts += [None, "", " \n", texts[0], texts[0], texts[7]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "clash", 1) for i, t in zip(ids, texts)]
    return [*rows, rows[0], (None, texts[5], None, None), (None, "nameless words alone here", None, None), (rows[1][0], "same id, other text", "", 2)]


@pytest.mark.parametrize("text", [None, "", "A b", "a B c d e " * 50, "é É ß x\x1cy z \x0b\x0c w"])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == brute_print(text)


def test_like_brute_force(spark):
    rows = corpus()
    prints, least, _ = brute_components(rows)
    got = sorted(map(str, map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(str((r[0], f"{p:016x}", c)) for r, p, c in zip(rows, prints, least))


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    _, least, group = brute_components(rows)
    kept = deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "label"]
    expected = {}
    for r, c, g in zip(rows, least, group):
        if r[0] == c:
            expected[g] = min(expected.get(g, r), r, key=str)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected.values()))


def test_all_links_within_the_radius_are_connected(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    labels = {r["node"]: r["label"] for r in components(near_links(table)).collect()}
    for a in signed:
        for b in signed:
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert labels[a] == labels[b]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7), (1001, 1000)]
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1300)}}


def test_links_within_a_component_are_joined_once(spark, monkeypatch):
    """Rounds go on with what is still apart: the links of a dense group are not joined in each of them."""
    from otindex.llm import components as module

    rng, joined = random.Random(11), []
    links = [(a, b) for b in range(1, 200) for a in rng.sample(range(b), min(b, 12))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    way = rng.sample(range(2000, 2020), 20)
    links += list(zip(way[1:], way))
    whole = module.spread_join

    def counted(left, right, key, *more):
        if key in ("a", "b"):
            joined.append(left.count())
        return whole(left, right, key, *more)

    monkeypatch.setattr(module, "spread_join", counted)
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(200)}, **{k: 1000 for k in range(1000, 1101)}, **{k: 2000 for k in way}, 5000: 5000}
    assert len(joined) > 2 and sum(joined) <= 2.5 * len(links)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and deduplicate(empty).count() == 0


def test_links_of_all_seeds_make_one_graph(spark):
    """Several seeds at once: components over the union of their links, by brute force."""
    rows, seeds = corpus(), (42, 43, 44)
    _, _, group = brute_components(rows, seeds[0])
    for seed in seeds[1:]:
        more = brute_components(rows, seed)[2]
        for i, j in enumerate(more):
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least, expected = {}, {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    for r, g in zip(rows, group):
        if r[0] == least.get(g):
            expected[g] = min(expected.get(g, r), r, key=str)
    kept = sorted(str(tuple(r)) for r in deduplicate(spark.createDataFrame(rows, SCHEMA), seed=seeds).collect())
    assert kept == sorted(map(str, expected.values()))
    assert len(kept) < len(deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert deduplicate(spark.createDataFrame([], SCHEMA), seed=seeds).count() == 0


def test_the_pipeline_uses_several_seeds():
    import corpus_pipeline

    assert len(set(corpus_pipeline.SEEDS)) >= 3


def test_maps_and_dotted_names(spark):
    """Columns without an order and names with dots or backticks pass; equal ids still keep one row a component."""
    schema = "doc_id bigint, text string, `a.b` string, `c``d` int, m map<string,int>"
    rows = [(1, "x y z", "q", 1, {"k": 2}), (1, "x y z", "p", 1, {"k": 1}), (1, "x y z", "p", 1, {"k": 3}), (None, "u v w", None, None, None)]
    for seed in (42, (42, 43)):
        kept = deduplicate(spark.createDataFrame(rows, schema), seed=seed)
        assert kept.columns == ["doc_id", "text", "a.b", "c`d", "m"]
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (rows[1], rows[3])))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_only_values_that_may_have_a_close_one_emit_their_ball(spark, radius):
    """Whoever has another within the radius stays; nearly all of the scattered rest emits nothing."""
    rng = random.Random(9)
    alone, pairs = {(s, rng.getrandbits(64)) for s in (0, 1) for _ in range(300)}, set()
    for k in range(60):
        value = rng.getrandbits(64)
        pairs |= {(k % 2, value), (k % 2, value ^ sum(1 << b for b in rng.sample(range(64), max(1, radius))))}
    signed = [(s, v - (1 << 64) if v >> 63 else v) for s, v in alone | pairs]
    kept = {(r.seed, r.bits % (1 << 64)) for r in crowded(spark.createDataFrame(signed, "seed int, bits bigint"), radius, ("seed",)).collect()}
    if radius:
        assert pairs <= kept
    assert len(kept - pairs) < 30
