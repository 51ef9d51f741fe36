"""Profile comparison against a plain cell-by-cell recurrence."""

import math
import random

import numpy as np
import pytest

from helixframe.operators import profiles
from helixframe.sources import readers

LETTERS = "".join(profiles.AMINO)


def profile(name: str, seq: str, rng: random.Random) -> str:
    row = lambda values: "  ".join("*" if v == 0 else f"{-math.log(v):.5f}" for v in values)

    def emit(letter):
        w = [rng.random() + (25 if c == letter else 0.2) for c in LETTERS]
        return [x / sum(w) for x in w]

    def move(last):
        a, b, c = rng.uniform(0.02, 0.2), rng.uniform(0.02, 0.2), rng.uniform(0.3, 0.7)
        return [1 - a, a, 0, 1 - c, c, 1, 0] if last else [1 - a - b, a, b, 1 - c, c, c, 1 - c]

    out = ["HMMER3/f [3.3]", f"NAME  {name}", f"LENG  {len(seq)}", "ALPH  amino", "HMM     " + "   ".join(LETTERS), "   m->m m->i m->d i->m i->i d->m d->d", "  COMPO  " + row([1 / 20] * 20), "  " + row([1 / 20] * 20), "  " + row([0.9, 0.05, 0.05, 0.5, 0.5, 1, 0])]
    for k, c in enumerate(seq, 1):
        out += [f"  {k}  {row(emit(c))}  {k} {c.lower()} - - -", "  " + row([1 / 20] * 20), "  " + row(move(k == len(seq)))]
    return "\n".join([*out, "//"])


def plain(q, r):
    (_, qe, qt), (_, re_, rt) = q, r
    bg, s = profiles.background(LETTERS), np.zeros((5, len(qe), len(re_)))
    for i in range(1, len(qe)):
        for j in range(1, len(re_)):
            a, b, c = qt[i - 1], rt[j - 1], s[:, i - 1, j - 1]
            s[0, i, j] = math.log(sum(qe[i] * re_[j] / bg)) + max(0, c[0] + a[0] + b[0], c[1] + a[0] + b[3], c[2] + a[3] + b[0], c[3] + a[5] + b[0], c[4] + a[0] + b[5])
            s[4, i, j] = max(s[0, i, j - 1] + b[2], s[4, i, j - 1] + b[6])
            s[2, i, j] = max(s[0, i, j - 1] + qt[i][1], s[2, i, j - 1] + qt[i][4]) + b[0]
            s[3, i, j] = max(s[0, i - 1, j] + a[2], s[3, i - 1, j] + a[6])
            s[1, i, j] = max(s[0, i - 1, j] + rt[j][1], s[1, i - 1, j] + rt[j][4]) + a[0]
    return s.max()


def test_compare():
    rng = random.Random(4)
    seqs = ["MKTAYIAKQRQ", "MKTAIAKQRWQ", "GGWPLLHDE", "M", "TAYIAKKKQRQDE"]
    parsed = [profiles.parse(profile(f"p{k}", s, rng)) for k, s in enumerate(seqs)]
    for q in parsed:
        for r in parsed:
            assert profiles.compare(q, r)[0] == pytest.approx(plain(q, r), abs=1e-9)
    assert profiles.compare(parsed[0], parsed[0])[0] > profiles.compare(parsed[0], parsed[1])[0] > profiles.compare(parsed[0], parsed[2])[0]
    for bad in ("", "NAME x"):
        with pytest.raises(ValueError):
            profiles.parse(bad)


def test_operator(spark, tmp_path):
    rng = random.Random(4)
    texts = [profile(f"p{k}", s, rng) for k, s in enumerate(["MKTAYIAKQRQ", "GGWPLLHDE"])]
    (tmp_path / "set.hmm").write_text("\n".join(texts) + "\n")
    df = readers.profiles(spark, str(tmp_path / "set.hmm"))
    assert [(r.name, r.consensus) for r in profiles.report(df).orderBy("name").collect()] == [("p0", "mktayiakqrq"), ("p1", "ggwpllhde")]
    got = {(r.query, r.ref): r.score for r in profiles.compare_profiles(df, df.collect(), 0.5).collect()}
    assert got[("p0", "p0")] == pytest.approx(profiles.compare(profiles.parse(texts[0]), profiles.parse(texts[0]))[0])
    none = spark.createDataFrame([("x", None), ("y", ""), ("z", "NAME z")], "name string, text string")
    assert profiles.compare_profiles(none, df.collect()).count() == 0
