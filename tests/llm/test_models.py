"""Plain twins of the toxicity machine and of the compression classifier."""

import itertools
import math

import numpy as np
import zstandard

import __spark_entry__
from epispark.llm import quality, toxicity
from epispark.llm.common import labelled_sample, table
from epispark.llm.toxicity import LONGEST, Kernel, Model, folded, forms, tokens_of

Q = __spark_entry__.queries()


def plain_counts(u, kernel):
    """Every gapped subsequence of three characters, by trying all places."""
    out = {}
    for i, j, k in itertools.combinations(range(len(u)), 3):
        if k - i < kernel.span:
            s = u[i] + u[j] + u[k]
            out[s] = out.get(s, 0.0) + kernel.decay ** (k - i + 1)
    return out


def plain_kernel(a, b, kernel):
    x, y = plain_counts(a, kernel), plain_counts(b, kernel)
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    both = norm(x) * norm(y)
    return sum(v * y.get(s, 0.0) for s, v in x.items()) / both if both else 0.0


def words(rng, n):
    return ["".join(rng.choice(list("abcdeé1"), rng.integers(1, LONGEST + 1))) for _ in range(n)]


def test_kernel_counts_all_subsequences():
    rng = np.random.default_rng(2)
    a, b, kernel = words(rng, 60), words(rng, 20), Kernel()
    got = kernel.against(a, b)
    assert np.allclose(got, [[plain_kernel(x, y, kernel) for y in b] for x in a], atol=1e-9)
    assert abs(kernel.against(["idiot"], ["idiot"])[0, 0] - 1) < 1e-12
    assert kernel.against(["idxiot"], ["idiot"])[0, 0] > 0.5 > kernel.against(["pilot"], ["idiot"])[0, 0]


def test_folded_weights_give_the_kernel_machine():
    rng = np.random.default_rng(3)
    kernel, landmarks, units = Kernel(), sorted(set(words(rng, 40))), words(rng, 300)
    alpha = rng.standard_normal(len(landmarks))
    letters = sorted({ord(c) for w in [*landmarks, *units] for c in w})
    classes = {c: k + 1 for k, c in enumerate(letters)}
    size = len(letters) + 1
    model = Model(kernel, classes, size, folded(kernel, landmarks, alpha, classes, size), -0.5, 1.0, 0.0)
    want = kernel.against(units, landmarks) @ alpha
    want = np.where(want > 1e-6, want, 0) - 0.5  # what does not point towards toxic counts as nothing
    assert np.allclose(model.units(units), want, atol=1e-4)


def test_texts_are_scored_by_their_most_suspicious_unit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(labelled_sample(d, table(spark, sf, "labels"), "toxic", toxicity.PARTS, toxicity.HELD_OUT, 800))
    got = {r["doc_id"]: r["score"] for r in Q["op1_toxicity"](spark, sf).collect()}
    weight = {}

    def decision(u):
        """The folded weights, one subsequence after the other."""
        if u not in weight:
            c = [model.classes.get(ord(x), 0) for x in u]
            raw = sum(model.kernel.decay ** (k - i + 1) * float(model.weights[(c[i] * model.size + c[j]) * model.size + c[k]]) for i, j, k in itertools.combinations(range(len(u)), 3) if k - i < model.kernel.span)
            norm = math.sqrt(sum(v * v for v in plain_counts(u, model.kernel).values()))
            weight[u] = model.offset + (raw / norm if raw > 1e-6 else 0.0)
        return weight[u]

    for r in d.collect()[:60]:
        units = [f for t in tokens_of(r["text"] or "") for f in forms(t)]
        top = max([decision(u) for u in units if len(u) > 2] + [model.offset])
        damped = math.copysign(math.log1p(abs(top)), top)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(model.slope * damped + model.shift)))) < 1e-4


def test_quality_is_the_difference_of_two_plain_sizes(spark, sf):
    d, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = quality.fit(labelled_sample(d, labels, "quality", quality.PARTS, quality.HELD_OUT, 1500))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in Q["op4_quality"](spark, sf).collect()}

    def size(data, dictionary):
        total = 0
        for k in range(0, len(data), 1024):
            tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(tool.compress(data[k : k + 1024]))
        return total

    for r in d.collect()[:40]:
        data = (r["text"] or "").encode()
        x = (size(data, model.bad) - size(data, model.good)) / max(len(data), 1)
        want = 1 / (1 + math.exp(-(model.slope * x + model.shift)))
        assert abs(got[r["doc_id"]][0] - want) < 1e-9
        assert got[r["doc_id"]][1] == int(want >= 0.5)


def test_a_run_leaves_one_table_of_documents(spark, sf):
    import glob

    import corpus_pipeline
    from epispark.session import shared_folder

    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/written-*"
    before = set(glob.glob(folder))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(set(glob.glob(folder)) - before) == 1
