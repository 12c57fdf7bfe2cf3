"""The tagger's gradients, its fit, its accuracy on lines of no generator, the gate's recall, trimming, and whole texts."""

import os
import platform
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pii_lines import NOTHING, labelled
from pyspark.sql import functions as F

from orderloom.llm import pii
from orderloom.llm.pii_examples import TYPES, Maker
from orderloom.llm.tagger import Tagger
from orderloom.sources.tables import table

PARTS = [("Anna", "given"), ("Marco", "given"), ("Grace", "given"), ("Ostansky", "family"), ("Velkmere", "family"), ("Page", "given")]


def test_gradients():
    maker = Maker(1, PARTS)
    words = pii.Words(pii.gazetteer(PARTS), pii.ordinary_words())
    examples = [pii.encode_example(*maker.window(30), words, 30) for _ in range(4)]
    chars, flags, gold = (np.stack(x) for x in zip(*examples))
    tagger = Tagger.fresh(TYPES, 5, 2)
    _, g = tagger.gradient(chars, flags, gold)
    for name, w in tagger.weights.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = tagger.gradient(chars, flags, gold)[0]
        w[at] = old - 1e-2
        down = tagger.gradient(chars, flags, gold)[0]
        w[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=0.02), name


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    tagger = Tagger.fresh(("a", "b"), 4, 1)
    step = rng.standard_normal((5, 5)).astype(np.float32) + tagger.allowed()
    emit = rng.standard_normal((4, 5, 30)).astype(np.float32)
    got = Tagger._viterbi(emit, step, np.ones((4, 30), bool))
    for b in range(30):
        paths = np.stack(np.meshgrid(*[np.arange(5)] * 4, indexing="ij"), -1).reshape(-1, 4)
        score = sum(emit[t, paths[:, t], b] for t in range(4)) + sum(step[paths[:, t], paths[:, t + 1]] for t in range(3))
        score = np.where(np.isin(paths[:, 0], [2, 4]), -1e9, score)
        assert list(paths[score.argmax()]) == got[:, b].tolist()


def test_rounds_go_on_from_the_mean_of_their_shards(spark, monkeypatch):
    for name, value in (("ROUNDS", 2), ("STEPS", 3), ("POOL", 150)):
        monkeypatch.setattr(pii, name, value)
    parts = tuple(PARTS)
    got = pii.trained(spark, parts)
    monkeypatch.undo()  # tasks have the rate of the whole number of steps
    want = Tagger.fresh(TYPES, pii.HIDDEN, 7)
    state = want.fresh_state()
    for k in range(2):
        each = [(Tagger({x: w.copy() for x, w in want.weights.items()}, TYPES), {x: w.copy() for x, w in state.items()}) for _ in range(pii.SHARDS)]
        for i, (own, moments) in enumerate(each):
            seed = 1000 * (k + 1) + i
            pii._train_some(own, moments, pii._pool(parts, pii.TOKENIZER, seed, 150), seed, 3 * k, 3)
        want.weights = {x: sum(t.weights[x] for t, _ in each) / len(each) for x in want.weights}
        state = {x: sum(m[x] for _, m in each) / len(each) for x in state}
    for x, w in want.weights.items():
        assert got.weights[x] == pytest.approx(w, abs=1e-3), x


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="counts what glibc does")
def test_steps_map_no_memory_anew():
    """A fresh process's steps work in memory that it has: mapped anew, theirs are some 4,500 pages a step."""
    script = """
import resource
import numpy as np
from orderloom.llm import pii
pool = (np.full((600, 120), 5, np.uint8), np.zeros((600, 120), np.uint8), np.zeros((600, 120), np.int64))
tagger = pii.Tagger.fresh(pii.TYPES, pii.HIDDEN, 7)
state = tagger.fresh_state()
pii._train_some(tagger, state, pool, 1, 0, 3)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
pii._train_some(tagger, state, pool, 1, 3, 5)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 5)
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "OMP_NUM_THREADS": "1"}
    assert int(subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, check=True).stdout) < 1500


@pytest.fixture(scope="module")
def parts_table(spark):
    return table(spark, "/root/testdata/sf0.01", "name_parts")


@pytest.fixture(scope="module")
def finder(parts_table):
    return pii.Finder(*pii._finder(parts_table))


def test_recall_on_lines_of_no_generator(finder):
    """300 lines written by hand: at least 0.9 of each type's values are found whole, and nearly all marks are true."""
    lines = labelled()
    assert len(lines) >= 300
    got = finder([x for x, _ in lines])
    for kind in TYPES:
        want = {(i, *s) for i, (_, f) in enumerate(lines) for s in f if s[2] == kind}
        have = {(i, *s) for i, f in enumerate(got) for s in f if s[2] == kind}
        assert len(want & have) / len(want) >= 0.9, kind
        assert len(want & have) / len(have) >= 0.9, kind


def test_lines_without_personal_data(finder):
    assert sum(bool(x) for x in finder(NOTHING)) <= len(NOTHING) // 10


def test_names_that_are_words(finder):
    """Names such as Grace are found wherever the lines have them, in 0.9 of all places."""
    lines = [(x, f) for x, f in labelled() if "Grace" in x]
    got = finder([x for x, _ in lines])
    want = {(i, *s) for i, (x, f) in enumerate(lines) for s in f if x[s[0] : s[1]].startswith("Grace")}
    assert len(want) > 15
    assert len(want & {(i, *s) for i, f in enumerate(got) for s in f}) / len(want) >= 0.85


def test_gate_loses_nothing(finder):
    lines = [x for x, f in labelled() if f]
    assert sum(map(finder.gate, lines)) / len(lines) >= 0.99
    maker = Maker(77, PARTS)
    drawn = [x for x, f in (maker.window(200) for _ in range(2000)) if f]
    assert sum(map(finder.gate, drawn)) / len(drawn) >= 0.99
    assert not finder.gate("return sum(x for x in values if x)")


def test_the_tagger_decides(finder):
    """The same digits are one type or the other, or none, by what stands around them."""
    kinds = [[k for _, _, k in x] for x in finder(["phone: 0171 2345678", "SSN: 219-09-9999", "sha1 9f86d081884c7d659a2feaa0c55ad015", "rows 21909 of 9999"])]
    assert kinds == [["phone"], ["national_id"], [], []]


@pytest.mark.parametrize(
    ("text", "marked", "kind", "value"),
    [
        ("mail anna.b@x.example now", "anna.b@x.exam", "email", "anna.b@x.example"),
        ("mail anna.b@x.example now", "anna.b@x.example now", "email", "anna.b@x.example"),
        ("to anna [at] x [dot] example,", "anna [at] x", "email", "anna [at] x [dot] example"),
        ("tel. +44 (0)1632 960788 or", "44 (0)1632 960788", "phone", "+44 (0)1632 960788"),
        ("fax (02) 5550 1234;", "02) 5550 1234", "phone", "(02) 5550 1234"),
        ('x = "917-16-3626"', '"917-16-3626"', "national_id", "917-16-3626"),
        ("to 60 Oldenby St., then", "60 Oldenby St", "street", "60 Oldenby St."),
        ("come to Hauptweg 12 by noon", "Hauptweg 12 by", "street", "Hauptweg 12"),
        ("by Velkmere, A.;", "Velkmere, A.;", "name", "Velkmere, A."),
        ("by Velkmere-Tarnetto, Anna.", "Tarnetto, Anna.", "name", "Tarnetto, Anna"),
        ("ask Anna van der Berg back", "Anna van der Berg back", "name", "Anna van der Berg"),
    ],
)
def test_trim(text, marked, kind, value):
    at = text.index(marked)
    s, e = pii.trim(text, at, at + len(marked), kind)
    assert text[s:e] == value


@pytest.mark.parametrize(
    ("text", "value", "kind", "want"),
    [
        ("mail security@x.example now", "security@x.example", "email", False),
        ("postgres://svc:12a3@db.x.example/t", "12a3@db.x.example", "email", False),
        ("anna@x.example", "anna@x.example", "email", True),
        ("in Velkmere", "Velkmere", "name", False),
        ("at 10.42.114.11", "10.42.114.11", "phone", False),
        ("on 2023-04-17", "2023-04-17", "national_id", False),
    ],
)
def test_definitions(text, value, kind, want):
    at = text.index(value)
    assert pii.counts(text, at, at + len(value), kind) is want


def test_long_lines_are_cut_in_overlapping_windows():
    line = "".join(chr(97 + i % 26) for i in range(1000))
    cut = pii.windows_of(line)
    assert all(line[a : a + len(w)] == w for a, w in cut)
    assert cut[-1][0] + len(cut[-1][1]) == 1000
    assert all(b[0] - a[0] == pii.WINDOW - pii.OVERLAP for a, b in zip(cut, cut[1:]))


def test_documents(spark, parts_table):
    line = "# Author: Anna Lindqvist <anna.lindqvist@mail.example>\n"
    filler = "x = compute(1, 2)\n" * 4000
    long = ("a=1;" * 30 + "/* TODO: ring Marco Lombardo back on +44 7700 900123 before the cut */") * 40
    rows = [(1, line), (1, line), (2, None), (3, ""), (4, filler + line.replace("\n", "\r\n") + filler), (5, long), (None, line), (6, "no person here\n" * 50)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start", F.lit("clash"))
    parts = parts_table.unionByName(spark.createDataFrame([(None, "given"), ("Anna", None)], "name_part string, part_kind string"))
    found = pii.find_pii(df, parts).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["pii_type"], r["pii_value"]))
    person = {("name", "Anna Lindqvist"), ("email", "anna.lindqvist@mail.example")}
    assert set(by) == {1, 4, 5, None}
    assert {x[2:] for x in by[1]} == person and len(by[1]) == 4
    assert {x[2:] for x in by[4]} == person and all((filler + line)[s:e] == v for s, e, _, v in by[4])
    phones = [x for x in by[5] if x[2] == "phone"]
    assert len(phones) == 40 and {x[3] for x in phones} == {"+44 7700 900123"}
    assert all(long[s:e] == v for s, e, _, v in by[5])
    clean = {(r["doc_id"], r["n_replaced"]): r["text"] for r in pii.redact_pii(df, parts).collect()}
    assert clean[1, 2] == "# Author: [NAME] <[EMAIL]>\n"
    assert clean[2, 0] is None and clean[3, 0] == ""
    assert clean[4, 2] == filler + "# Author: [NAME] <[EMAIL]>\r\n" + filler
    assert pii.find_pii(df.limit(0), parts).count() == 0


def test_memory_of_lines_changes_nothing(finder, monkeypatch):
    lines = [x for x, _ in labelled()][:60]
    want = finder(lines)
    monkeypatch.setattr(pii, "REMEMBERED", 0)
    other = pii.Finder(Tagger(dict(finder.tagger.weights), TYPES), finder.gate.parts)
    other.tagger = finder.tagger
    assert [other([x])[0] for x in lines] == want
