"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import edited, groups, line_groups, made_up, shingles
from tests.llm.test_rules import base

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(21)
    shared = " ".join(made_up(rnd, 30))
    texts = {}
    for i in range(30):
        lines = [" ".join(made_up(rnd, rnd.randint(25, 40))) for _ in range(2)]
        if i % 5 == 0:
            lines.insert(1, shared)
        if i % 7 == 0:
            lines.append(" ".join(edited(rnd, shared.split(" "), 0.02)) + " end")
        texts[i] = "\n".join(lines)
    texts[40] = texts[3]
    texts[41] = texts[4] + " more words"
    texts |= {50: None, 51: "", 52: "too short", 53: "\n\n", 54: " ".join(made_up(rnd, 3000))}
    rows = [(i, t, "en", rnd.choice(("s1", "s2", None)), None if t is None else len(t)) for i, t in texts.items()]
    return rows + [rows[5], (None, "a text without an id " + " ".join(made_up(rnd, 20)), "en", "s1", 5)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = [r for r in rows if (b := base(r[1]))[0] >= 10 and 100 * b[4] <= 20 * b[0]]
    out = [tuple(r) for r in STAGE["quality_rules"](spark, docs, str(tmp_path)).collect()]
    assert Counter(out) == Counter(good)
    gone = line_groups(sorted({(r[0], r[1]) for r in good if r[0] is not None}))
    cut = []
    for r in good:
        lines = r[1].split("\n")
        left = [x for n, x in enumerate(lines) if (r[0], n) not in gone]
        if left:
            cut.append((r[0], "\n".join(left), *r[2:4], len("\n".join(left))))
    assert len(cut) < len(good) and sum(r[4] for r in cut) < sum(r[4] for r in good if r in good)
    out = [tuple(r) for r in STAGE["line_dedup"](spark, spark.createDataFrame(good, SCHEMA), str(tmp_path)).collect()]
    assert Counter(out) == Counter(cut)
    near = cut + [(60 + i, r[1] + " tail", *r[2:]) for i, r in enumerate(cut[:5])]
    sets = {i: shingles(t, 5) for i, t, *_ in near if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(sets, links)
    out = [tuple(r) for r in STAGE["near_dedup"](spark, spark.createDataFrame(near, SCHEMA), str(tmp_path)).collect()]
    assert len(links) >= 5 and Counter(out) == Counter({r for r in near if r[0] is None or root[r[0]] == r[0]})
    assert Counter(tuple(r) for r in STAGE["mix_sources"](spark, spark.createDataFrame(near, SCHEMA), str(tmp_path)).collect()) == Counter(near)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    root = groups(range(len(cut)), [(a, b) for a in range(len(cut)) for b in range(a) if cut[a][0] is not None and cut[b][0] is not None and 100 * len((x := shingles(cut[a][1], 5)) & (y := shingles(cut[b][1], 5))) >= 80 * len(x | y)])
    kept = {cut[i][0]: cut[i][1] for i in root if root[i] == i}
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in kept.items()}
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    assert dict(held) == want


@pytest.mark.parametrize("name", list(STAGE))
def test_stage_of_an_empty_table(spark, tmp_path, name):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGE[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)
