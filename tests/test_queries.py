"""Each query against its SQL on the smallest tables, and golden cases of the operators."""

import itertools
import math
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import chains, digits, geometry, hashes, kernels, parts, text
from cellweave.operators import cells, clusters, compare, curation, mapping, pictures, progress, running, signal, spectrum, templates
from cellweave.plans import registry
from cellweave.sources import images, readers, writers
from cellweave.streaming import early_abort
from cellweave.streaming.early_abort import replayed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted([plain(r[i]) for i in at] for r in result.fetchall())


def test_entry_works_without_the_optional_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/cellweave", f"{tmp_path}/cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_labels' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


class TestCompare:
    def compare(self, spark, cases):
        truth = frame(spark, [("p", i, 0, e) for i, (e, _) in enumerate(cases) if e is not None], "puzzle string, row int, col int, expected int")
        guess = frame(spark, [("p", i, 0, a, 1.0) for i, (_, a) in enumerate(cases) if a is not None], "puzzle string, row int, col int, actual int, confidence double")
        return compare.compare_cells(truth, guess, ["puzzle", "row", "col"])

    def test_mixed(self, spark):
        m = compare.metrics(self.compare(spark, [(1, 1), (2, 2), (3, 4), (5, None), (None, 6)])).first()
        assert (m["correct"], m["incorrect"], m["missed"], m["extra"]) == (2, 1, 1, 1)
        assert (m["accuracy"], m["coverage"]) == (0.5, 0.75) and m["precision"] == m["recall"] == m["f1"] == pytest.approx(2 / 3)

    def test_empty(self, spark):
        m = compare.metrics(self.compare(spark, [])).first()
        assert m["accuracy"] == m["f1"] == m["coverage"] == 0

    def test_per_label(self, spark):
        got = {r["digit"]: r for r in compare.per_label_metrics(self.compare(spark, [(5, 5), (5, 7)])).collect()}
        assert len(got) == 27 and got[5]["precision"] == 1 and got[5]["recall"] == 0.5 and got[7]["fp"] == 1 and got[1]["tp"] == 0

    def test_aborted(self, spark):
        truth = frame(spark, [("p", 0, 0, 3), ("q", 0, 0, 3)], "puzzle string, row int, col int, expected int")
        guess = frame(spark, [("p", 0, 0, 3, 1.0), ("q", 0, 0, 3, 1.0)], "puzzle string, row int, col int, actual int, confidence double")
        out = {r["puzzle"]: r["match"] for r in compare.compare_cells(truth, guess, ["puzzle", "row", "col"], frame(spark, [("q",)], "puzzle string")).collect()}
        assert out == {"p": "correct", "q": "aborted"}

    def test_batch(self, spark):
        rows = [("a", 1, 1, 0, 0, 0, 4), ("b", 0, 0, 0, 0, 5, 0)]
        b = compare.batch_metrics(frame(spark, rows, "puzzle string, correct long, incorrect long, missed long, extra long, aborted long, edit_distance long")).first()
        assert b["total_puzzles"] == 2 and b["scored_puzzles"] == 1 and b["accuracy"] == 0.5 and b["average_edit_distance"] == 4
        none = compare.batch_metrics(frame(spark, rows[1:], "puzzle string, correct long, incorrect long, missed long, extra long, aborted long, edit_distance long")).first()
        assert math.isnan(none["average_edit_distance"])

    def test_edit_distance(self, spark):
        cases = [([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [4, 5, 6], 3), ([1, 2, 3], [1, 2, 3, 4], 1), ([1, None, 3], [1, 2, 3], 1), ([], [], 0)]
        df = frame(spark, [(i, a, b) for i, (a, b, _) in enumerate(cases)], "k int, a array<int>, b array<int>")
        df = df.select("k", text.sequence_string(F.col("a")).alias("a"), text.sequence_string(F.col("b")).alias("b"))
        assert {r["k"]: r["edit_distance"] for r in compare.edit_distances(df, "k", "a", "b").collect()} == {i: d for i, (_, _, d) in enumerate(cases)}


class TestScalars:
    def one(self, spark, column, value, kind="string"):
        return frame(spark, [(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]

    def test_fix_spurious(self, spark):
        df = frame(spark, [(n,) for n in (34, 24, 28, 30, 99, 0, -1, 100, 27)], "x int")
        assert [r[0] for r in df.select(digits.fix_spurious(F.col("x"))).collect()] == [3, 24, 2, 3, 9, None, None, None, 27]

    def test_look_alikes(self, spark):
        assert self.one(spark, digits.sanitize_digits, "o O i I l L | z Z s S b B g G q Q x") == "00111112255669999"

    def test_post_process(self, spark):
        assert self.one(spark, text.post_process, "  hello   world \r\n\r\n\r\n -- . \n élan vital ") == "Hello world\nÉlan vital"

    def test_numbers(self, spark):
        df = frame(spark, [(s,) for s in ("12", "a35", "00", "345", "x", "")], "x string")
        assert [r[0] for r in df.select(digits.sanitize_number(F.col("x"))).collect()] == [12, 3, None, 3, None, None]
        assert self.one(spark, lambda c: digits.js_round(c), -2.5, "double") == -2

    def test_formats(self, spark):
        assert self.one(spark, text.byte_size, 1536, "long") == "1.5 KB" and self.one(spark, text.byte_size, 0, "long") == "0 Bytes"
        assert self.one(spark, text.ctc_encode, "27") == [3, 8, 0, 0]
        assert self.one(spark, text.label_line, "a.png, 7")["label"] == 7 and self.one(spark, text.label_line, "a,b,7") is None
        row = self.one(spark, text.log_line, 'x pista 4: "Um" conf=81%')
        assert (row["number"], row["text"], row["confidence"]) == ("4", "Um", "81")

    def test_geometry(self, spark):
        rows = [((10.0, 1.0, [0.0] * 7), (20.0, 1.5, [1.0] * 7))]
        d = frame(spark, rows, "a struct<area:double,aspect_ratio:double,moments:array<double>>, b struct<area:double,aspect_ratio:double,moments:array<double>>").select(geometry.feature_distance(F.col("a"), F.col("b"))).first()[0]
        assert d == pytest.approx(0.2 * 0.5 + 0.3 * 0.5 + 0.5)


class TestCells:
    def grid(self, spark, rows):
        return frame(spark, [(1, r, c, n, f) for r, c, n, f in rows], "puzzle long, row int, col int, number int, confidence double")

    def test_outliers_read_the_grid_as_it_was(self, spark):
        g = self.grid(spark, [(0, 0, 1, 0.9), (0, 1, 2, 0.9), (0, 2, 3, 0.9), (1, 1, 25, 0.1), (1, 0, 24, 0.1)])
        out = {(r["row"], r["col"]): r["number"] for r in cells.drop_outliers(g).collect()}
        assert out[(1, 1)] is None and out[(1, 0)] is None and out[(0, 0)] == 1

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 3), st.floats(0, 1)), min_size=1, max_size=30))
    def test_cap_never_takes_sure_cells(self, spark, values):
        g = self.grid(spark, [(i // 6, i % 6, n, f) for i, (n, f) in enumerate(values)])
        for r in cells.cap_frequencies(g).collect():
            assert not r["capped"] or r["confidence"] < 0.6

    def test_overrides_by_presence(self, spark):
        g = self.grid(spark, [(0, 0, 1, 0.9), (0, 1, 2, 0.9)])
        o = frame(spark, [(1, 0, 0, None)], "puzzle long, row int, col int, number int")
        assert {(r["col"]): r["effective"] for r in cells.with_overrides(g, o).collect()} == {0: None, 1: 2}

    def test_early_abort(self, spark):
        df = frame(spark, [(p, i, 1 if (p == 1 or i < 3) else None) for p in (1, 2) for i in range(40)], "puzzle long, ord int, number int")
        assert {r["puzzle"]: (r["aborted"], r["stopped_at"]) for r in cells.early_abort(df).collect()} == {1: (False, None), 2: (True, 16)}

    def test_early_abort_stream(self, spark):
        """Cells out of order and spread over micro-batches; a short last chunk is judged when the timer runs out."""
        r = random.Random(4)
        rows = [(p, i + 1, r.random() < share) for p, (n, share) in enumerate([(40, 1.0), (40, 0.0), (9, 0.0), (10, 0.1), (33, 0.3), (100, 0.24), (17, 0.24), (1, 1.0)]) for i in range(n)]
        rows += [(8, i + 1, i < 8) for i in range(33)]  # falls below a quarter with its last cell only
        df = frame(spark, rows, "puzzle long, nth long, recognised boolean")
        batch = cells.early_abort(df.select("puzzle", F.col("nth").alias("ord"), F.when(F.col("recognised"), 1).alias("number"))).select("puzzle", "stopped_at", "recognized", "aborted")
        want = sorted(map(tuple, batch.collect()))
        assert (8, 33, 0, True) in want and (2, None, 0, False) in want
        for files, at_once in ((6, 2), (1, 1)):
            assert sorted(map(tuple, replayed(df, files, at_once).collect())) == want

    def test_stop_rule_calls_for_state_by_group(self):
        """Calls for state do not grow with a group's puzzles (each puzzle took six calls and more a micro-batch before), but for spans ahead of long ones."""
        calls = []

        class Held:
            def __init__(self, empty):
                self.empty, self.value = empty, empty

            def get(self):
                calls.append("get")
                return self.value

            def update(self, value):
                calls.append("update")
                self.value = value

            put = update

            def clear(self):
                self.update(self.empty)

        class Ahead:
            def __init__(self):
                self.held = {}

            def containsKey(self, k):
                calls.append("ahead")
                return k in self.held

            def getValue(self, k):
                return self.held[k]

            def updateValue(self, k, v):
                calls.append("ahead")
                self.held[k] = v

            def removeKey(self, k):
                del self.held[k]

        class Handle:
            timers = set()
            judged, ahead, timer = Held([]), Ahead(), Held(None)
            getListState = getMapState = getValueState = lambda self, name, *_: getattr(self, name)
            registerTimer, deleteTimer = (lambda self, t: (calls.append("timer"), self.timers.add(t))), (lambda self, t: (calls.append("timer"), self.timers.remove(t)))

        class Expired:
            getExpiryTimeInMs = lambda self: 10**9

        r = random.Random(8)
        sizes = {p: r.randint(1, 200) for p in range(600)}
        cells_of = {p: [r.random() < p % 5 / 8 for _ in range(n)] for p, n in sizes.items()}
        cells_of[None] = [i % 3 == 0 for i in range(3000)]  # 188 chunks, three spans
        rows = [(0, p, i // 16, k, r.randint(1, 999), None) for p, found in cells_of.items() for i, k in enumerate(found)]
        r.shuffle(rows)
        handle, rule, got = Handle(), early_abort.StopRule(16, 10, 0.25, 1000), []
        rule.init(handle)
        for b in range(4):
            calls.clear()
            got += rule.handleInputRows((0,), iter(rows[b::4]), None)
            assert len([c for c in calls if c != "ahead"]) <= 6 and len(calls) < 40
            assert len(handle.timers) == 1
        got += rule.handleExpiredTimer((0,), None, Expired())
        assert not handle.judged.value and not handle.ahead.held
        want = {}
        for p, found in cells_of.items():
            stops = [n for n in [*range(16, len(found), 16), len(found)] if n >= 10 and sum(found[:n]) / n < 0.25]
            want[p] = (stops[0], 0, True) if stops else (None, sum(found), False)
        assert len(got) == len(want) and {x[0]: tuple(x)[1:] for x in got} == want

    def test_early_abort_stream_of_a_long_puzzle(self, spark):
        """Chunks beyond the span at hand lie in the map, and are fetched when their turn comes."""
        rows = [(p, i + 1, i % 3 == 0 and i < most) for p, n, most in ((1, 3000, 3000), (2, 3000, 1800), (3, 40, 40), (4, 1024, 1024)) for i in range(n)]
        got = {r["puzzle"]: tuple(r)[1:] for r in replayed(frame(spark, rows, "puzzle long, nth long, recognised boolean"), groups=2).collect()}
        stop = next(n for n in range(1808, 3001, 16) if 600 / n < 0.25)
        assert got == {1: (None, 1000, False), 2: (stop, 0, True), 3: (None, 14, False), 4: (None, 342, False)}

    def test_running_sums(self, spark):
        rows = [(k, i, None if i % 7 == 0 else i) for k, n in ((1, 500), (2, 3), (None, 20)) for i in range(n)]
        got = running.running_sums(frame(spark, rows, "k int, i int, v int").repartition(5), "k", ["i"], {"upto": F.col("v"), "nth": F.lit(1)}).collect()
        assert len(got) == len(rows)
        for row in got:
            assert row["nth"] == row["i"] + 1 and row["upto"] == sum(i for i in range(row["i"] + 1) if i % 7)

    def test_stage_progress(self, spark):
        events = []
        stages = {"preprocessing": lambda c: c, "gridDetection": lambda c: c.where("id < 3"), "cellExtraction": lambda c: c.select(F.raise_error(F.lit("no cells")).alias("id"))}
        with pytest.raises(progress.StageFailed, match="cellExtraction"):
            progress.run_stages(spark.range(10), stages, {"n": F.count(F.lit(1))}, lambda *e: events.append(e))
        assert events == [("preprocessing", 10, {}), ("preprocessing", 25, {"n": 10}), ("gridDetection", 25, {}), ("gridDetection", 45, {"n": 3}), ("cellExtraction", 45, {})]


class TestSpectrum:
    """The joins against numpy on dense arrays."""

    @pytest.fixture
    def found(self, spark):
        r = np.random.default_rng(2)
        n = 230
        dense = {
            "noise": r.integers(0, 9, n).astype(float), "day": (np.arange(n) % 24 == 5) * 7.0 + r.integers(0, 2, n), "one": (np.arange(n) == 40) * 3.0, "flat": np.full(n, 2.0),
            "half": (np.arange(n) % 12 == 1) * 2.0 + (np.arange(n) % 24 == 1) * 3.0, "ends": (np.arange(n) % (n - 1) == 0) * 1.0,
        }
        rows = [(k, int(i) + 1000, float(x[i])) for k, x in dense.items() for i in np.flatnonzero(x)]
        return dense, spectrum.signals(frame(spark, rows, "key string, pos long, amplitude double"), "key")

    def test_autocorrelation(self, found):
        dense, s = found
        got = {r["key"]: (r["period"], r["snr"]) for r in spectrum.autocorrelation_period(s, "key", 6, 48).collect()}
        assert got["flat"] == (6.0, 0.0)
        for k, x in dense.items():
            if k != "flat":
                y = x - x.mean()
                c = np.correlate(y, y, "full")[len(x) - 1 :] / (y * y).sum()
                assert got[k][1] == pytest.approx(c[6:49].max() / np.sqrt((c[6:49] ** 2).mean()))
                assert abs(got[k][0] - (6 + int(np.argmax(np.round(c[6:49], 12))))) <= 0.5
        assert got["day"][0] == pytest.approx(24, abs=0.5)

    def test_spectrum(self, found):
        dense, s = found
        got = {(r["key"], r["k"]): r["magnitude"] for r in spectrum.magnitudes(s, "key", 6, 48).collect()}
        for k, x in dense.items():
            full = np.abs(np.fft.rfft(x * np.hanning(len(x)), 512))
            assert [got[k, i] for i in range(11, 86)] == pytest.approx(full[11:86].tolist(), abs=1e-6)
        assert (("day", 86) in got) is False
        by = {r["key"]: r for r in spectrum.dominant_period(s, "key", 6, 48).collect()}
        assert by["day"]["method"] == "autocorrelation" and by["noise"]["method"] == "spectrum"
        # the strongest wave of "half" is of 12 places; it is led down to 24
        half = {r["key"]: r["period"] for r in spectrum.spectrum_period(s, "key", 6, 48).collect()}["half"]
        assert half == pytest.approx(24, abs=1)

    def test_smoothing_and_peaks(self, found):
        dense, s = found
        got = {(r["key"], r["i"]): r["x"] for r in spectrum.smooth(s, "key", 2.2).collect()}
        peaks = {k: sorted(r["i"] for r in rows) for k, rows in itertools.groupby(sorted(spectrum.local_peaks(spectrum.smooth(s, "key", 2.2), "key", 9).collect(), key=lambda r: r["key"]), key=lambda r: r["key"])}
        for k, x in dense.items():
            want = kernels.gaussian_smooth(x, 2.2)
            assert [got.get((k, i), 0.0) for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-8)
            want, taken = np.round(want, 9), []
            for p in sorted(range(1, len(x) - 1), key=lambda i: (-want[i], i)):
                if want[p] > 0 and want[p] >= want[p - 1] and want[p] >= want[p + 1] and all(abs(p - q) >= 9 for q in taken):
                    taken.append(p)
            assert peaks.get(k, []) == sorted(taken)
        assert spectrum.smooth(s, "key", 0.4) is s

    def test_borders(self, spark, found):
        dense, s = found
        day = [r["pos"] for r in spectrum.borders_by_period(s, "key", 24).where("key = 'day'").orderBy("pos").collect()]
        assert day[0] == 5 and set(np.diff(day)) == {24}
        both = spectrum.positions_by_peaks(s, "key", 12).collect()
        for k in ("day", "noise", "one"):  # the loops over one dense signal
            assert sorted(r["pos"] for r in both if r["key"] == k) == chains.positions_by_peaks(dense[k], 12)
        assert day == chains.borders_by_period(dense["day"], 24)
        lines = spectrum.grid_lines(frame(spark, [("a", 5.4), ("b", 23.0), ("c", 0.0)], "key string, phase double"), "key", 24.0, F.lit(100).cast("long"))
        assert {k: sorted(r["pos"] for r in lines.where(F.col("key") == k).collect()) for k in "abc"} == {"a": [5, 29, 53, 77, 100], "b": [0, 23, 47, 71, 95], "c": [0, 24, 48, 72, 96]}

    def test_perceptual_hash(self, spark):
        r = np.random.default_rng(3)
        images = r.normal(size=(20, 8, 8))
        rows = [(i, x.ravel().tolist()) for i, x in enumerate(images)] + [(20, None), (21, [1.0]), (22, [float("nan")] * 64), (23, [0.0] * 64)]
        got = {r["i"]: r["h"] for r in frame(spark, rows, "i int, x array<double>").select("i", hashes.perceptual_hash(F.col("x"), 8).alias("h")).collect()}
        basis = np.array(hashes.cosine_basis(8, 8))
        for i, x in enumerate(images):
            c = (basis @ x @ basis.T).ravel()[1:]
            assert got[i] == sum(1 << j for j, t in enumerate(c) if t > np.sort(c)[31])
        assert [got[i] for i in (20, 21, 22, 23)] == [None, None, None, 0]


class TestSignals:
    def positions(self, spark, rows):
        return frame(spark, [(1, p, a) for p, a in rows], "key long, pos long, amplitude long")

    def test_folds(self, spark):
        p = self.positions(spark, [(0, 1), (5, 3), (30, 1), (33, 9), (60, 2)])
        assert [r["pos"] for r in signal.dedupe_fold(p, "key", 12).orderBy("pos").collect()] == [5, 33, 60]
        assert [(r["anchor"], r["members"]) for r in signal.anchor_groups(p, "key", 10).orderBy("anchor").collect()] == [(0, 2), (30, 2), (60, 1)]
        assert sorted(r["pos"] for r in signal.nms_peaks(p, "key", 12).collect()) == [5, 33, 60]
        assert [r["line"] for r in signal.merge_close(p, "key", 10).orderBy("line").collect()] == [2.5, 31.5, 60.0]

    def test_kmeans_is_the_plain_loop(self, spark):
        r = np.random.default_rng(1)
        v = np.concatenate([r.normal(m, 1, 30) for m in (0, 10, 30)]).round(2)
        got = signal.kmeans_1d(frame(spark, [(1, float(x)) for x in v], "key long, v double"), "key", "v", 3).first()["centroids"]
        s = np.sort(v)
        c = np.array([s[i * len(s) // 3] for i in range(3)])
        for _ in range(10):
            own = np.argmin(np.abs(s[:, None] - c), axis=1)
            c = np.array([s[own == i].mean() if (own == i).any() else c[i] for i in range(3)])
        assert got == pytest.approx(c.tolist())
        assert signal.kmeans_1d(frame(spark, [(1, 4.0)], "key long, v double"), "key", "v", 3).first()["centroids"] == [4.0]

    def test_regularize(self, spark):
        p = self.positions(spark, [(0, 1), (10, 1), (40, 1)])
        assert sorted(r["pos"] for r in signal.regularize(p, "key", F.lit(10)).collect()) == [0, 10, 20, 30, 40]

    def test_medians(self, spark):
        df = frame(spark, [([1, 2, 3, 10],)], "x array<int>")
        assert df.select(signal.upper_median(F.col("x"))).first()[0] == 3


class TestPictures:
    @staticmethod
    def flood(x):
        """Parts of one image by filling, in reading order."""
        left, out = {(int(y), int(z)) for y, z in np.argwhere(x)}, []
        while left:
            part, todo = set(), [min(left)]
            while todo:
                p = todo.pop()
                if p in left:
                    left.remove(p)
                    part.add(p)
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            out.append(part)
        return out

    @pytest.mark.parametrize("share", [0.2, 0.45, 0.7])
    def test_largest_parts(self, share):
        images = np.random.default_rng(7).random((60, 9, 13)) < share
        images[0], images[1] = False, True
        for x, got in zip(images, parts.largest_parts(images)):
            found = self.flood(x)
            if not found:
                assert got is None
                continue
            best = min(found, key=lambda p: (-len(p), min(p)))
            sides = {p: sum((p[0] + a, p[1] + b) not in best for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for p in best}
            rows, cols = [p[0] for p in best], [p[1] for p in best]
            assert got == (len(found), len(best), min(rows), min(cols), max(rows), max(cols), sum(sides.values()), sorted(y * 13 + z for (y, z), n in sides.items() if n))

    def test_edges(self):
        x = np.zeros((2, 12, 12), dtype=np.uint8)
        x[0, :, 6:] = 200  # a border
        x[1, 3:9, 3:9] = 20  # a faint square: weak edges that hang together with no strong one
        found = parts.edges(x, 50, 150)
        assert found[0].sum(axis=1).tolist() == [1] * 12 and found[0].any(axis=0).sum() == 1
        assert not found[1].any()
        x[1, 3, 3:9] = 80
        assert parts.edges(x, 50, 150)[1].sum() > 10

    def test_files(self, spark, tmp_path):
        r = np.random.default_rng(8)
        rows = [(f"a{i}.png", 7, r.integers(0, 256, 7 * (i + 1), dtype=np.uint8).tobytes()) for i in range(4)] + [("bad.png", 7, None)]
        images.write_images(frame(spark, rows, "name string, width int, pixels binary"), f"{tmp_path}/p").collect()
        got = {x["image"]["origin"].rsplit("/", 1)[1]: x["image"] for x in images.read_images(spark, f"file://{tmp_path}/p").collect()}
        assert {n: (g["width"], bytes(g["data"])) for n, g in got.items()} == {n: (w, d) for n, w, d in rows if d}

    def test_lines(self, spark):
        line = [(1, x, 2 * x + 3) for x in range(0, 40, 2)]
        cross = [(2, x, 7) for x in range(12)] + [(2, 5, y) for y in range(12)]
        found = {(r["k"], r["angle"], r["rho"]): r["votes"] for r in pictures.voted_lines(frame(spark, line + cross, "k long, x long, y long"), "k", 180, 11, 8).collect()}
        top = max((v, k) for k, v in found.items() if k[0] == 1)[1]
        assert abs(top[1] - 153) <= 1
        assert max(v for (k, a, rho), v in found.items() if k == 2 and abs(a - 90) <= 8 and abs(rho - 7) <= 1) >= 12 and found[2, 0, 5] >= 12

    def test_filled_up(self, spark):
        rows = [(i, 0 if i < 7 else 1 if i < 9 else None, [i] * 9) for i in range(10)]
        df = frame(spark, rows, "vec_id long, label int, pixels array<int>")
        got = pictures.filled_up(df, 3)
        assert {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 7, 1: 7, None: 7}
        assert sorted(map(str, got.collect())) == sorted(map(str, pictures.filled_up(df.repartition(5), 3).collect()))
        assert all(r["pixels"] == [r["vec_id"]] * 9 for r in got.where("copy = 0").collect()) and got.where("copy > 0").count() == 11

    def test_rectified(self, spark):
        image = np.zeros((60, 80), dtype=int)
        image[10:50, 20:70] = np.arange(40)[:, None] // 10 * 5 + np.arange(50)[None, :] // 10
        assert pictures.rectified(image, [(20, 10), (70, 10), (70, 50), (20, 50)], 4, 5).tolist() == np.arange(20).reshape(4, 5).tolist()
        corners = [(3.0, 2.0), (71.0, 9.0), (60.0, 55.0), (8.0, 40.0)]
        quad = frame(spark, [(1, *[v for c in corners for v in c])], "quad long, " + ", ".join(f"{c}{i} double" for i in range(4) for c in "xy"))
        to = pictures.homography(quad)
        for (u, v), want in zip(((0, 0), (1, 0), (1, 1), (0, 1)), corners):
            assert to.select(pictures.mapped("x", F.lit(u), F.lit(v)), pictures.mapped("y", F.lit(u), F.lit(v))).first() == pytest.approx(want)
        xs, ys = np.meshgrid(np.arange(80), np.arange(60))
        at = {(r["j"], r["i"]): (r["x"], r["y"]) for r in pictures.perspective_grid(quad, 3).collect()}
        for plane, n in ((xs, 0), (ys, 1)):
            flat = pictures.rectified(plane, corners, 3, 3)
            assert all(flat[k] == int(xy[n]) for k, xy in at.items())


class TestSymbols:
    def test_leader_pass_is_the_plain_loop(self, spark):
        r = np.random.default_rng(2)
        rows = [(1, i, f"h{i % 17}", float(r.integers(10, 40)), float(r.uniform(0.5, 2)), r.normal(0, 0.2, 7).tolist()) for i in range(40)]
        got = {x["ord"]: x["cluster"] for x in clusters.leader_pass(frame(spark, rows, "puzzle long, ord long, hash string, area double, aspect_ratio double, moments array<double>")).collect()}
        first = {}
        for row in rows:
            first.setdefault(row[2], row)
        want, seeds = {}, []
        alike = lambda a, b: 1 / (1 + 0.2 * abs(a[3] - b[3]) / max(a[3], b[3]) + 0.3 * abs(a[4] - b[4]) + 0.5 * np.abs(np.subtract(a[5], b[5])).mean()) >= 0.85
        for row in first.values():
            for n, seed in enumerate(seeds):
                if alike(seed, row):
                    want[row[1]] = n
                    break
            else:
                want[row[1]] = len(seeds)
                seeds.append(row)
        assert got == want

    def test_mapping(self, spark):
        s = frame(spark, [(1, "x", 5), (1, "y", 3), (1, "z", 3)], "g long, symbol_id string, n long")
        got = {r["symbol_id"]: r["suggested_letter"] for r in mapping.suggest(s, mapping.letter_table(spark), "g").collect()}
        assert got == {"x": "A", "y": "E", "z": "O"}
        m = frame(spark, [(1, "x", "A"), (1, "y", "A"), (1, "z", "")], "g long, symbol_id string, letter string")
        v = mapping.validate(s, m, "g").first()
        assert (v["duplicates"], v["unmapped"], v["valid"], v["complete"]) == (1, 1, False, True)  # an empty letter counts as set
        assert frame(spark, [('{"a":"B"}',), ("[1]",), ("x",)], "j string").select(mapping.import_mapping(F.col("j"))).collect()[0][0] == {"a": "B"}

    def test_templates(self, spark):
        a, b = [0.0] * 16, [1.0] * 16
        near = [0.02] * 16
        rows = [(1, 0, 26, 0.9, a), (1, 1, 26, 0.9, [0.0] * 12 + [1.0] * 4), (1, 2, 2, 0.3, near), (1, 3, 7, 0.9, b), (1, 4, None, 0.0, [0.95] * 16), (1, 5, 34, 0.9, [0.5] * 16)]
        out = {r["ord"]: r["number"] for r in templates.correct(frame(spark, rows, "puzzle long, ord long, number int, confidence double, pixels array<double>")).collect()}
        assert out[2] == 26 and out[4] == 7 and out[5] == 3


class TestCuration:
    @settings(max_examples=10, deadline=None)
    @given(st.dictionaries(st.sampled_from("abcd"), st.integers(1, 30), min_size=1))
    def test_split_sizes(self, spark, sizes):
        items = frame(spark, [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, digit string")
        got = {r["digit"]: r["n"] for r in curation.stratified_split(items, "digit", "id").where("split = 'train'").groupBy("digit").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k, n in sizes.items():
            cut = max(1, int(n * 0.8))
            assert got[k] == (cut - 1 if n >= 2 and cut == n else cut)

    def test_strategy(self, spark):
        rows = [(1, 0, 5, 0.96), (1, 1, 6, 0.99), (2, 0, None, 0.99), (2, 1, 3, 0.5), (2, 2, 4, 0.5)]
        got = {r["cell"]: r["number"] for r in curation.choose_strategy(frame(spark, rows, "cell long, strategy int, number int, confidence double"), ["cell"]).collect()}
        assert got == {1: 5, 2: 3}

    def test_truth_files(self, spark, tmp_path):
        good = '{"puzzleId":"a","sourceImage":"a.jpg","type":"numeric","dimensions":{"rows":1,"cols":2},"valueRange":{"min":1,"max":27},"grid":[[1,null]],"frequency":{"1":2},"metadata":{"validatedBy":"x","validatedAt":"t"}}'
        bad = good.replace('"a.jpg"', '""').replace("[[1,null]]", "[[1,99,3]]").replace('"puzzleId":"a"', '"puzzleId":"b"')
        (tmp_path / "a.json").write_text(good)
        (tmp_path / "b.json").write_text(bad)
        truth = readers.read_truth(spark, str(tmp_path))
        assert {(r["puzzle_id"], r["rule"]) for r in curation.violations(truth).collect()} == {("b", "sourceImage"), ("b", "cols"), ("b", "valueRange")}
        assert readers.truth_cells(truth.where("puzzleId = 'a'")).count() == 2
        assert curation.frequency_mismatches(truth.where("puzzleId = 'a'")).first()["counted"] == 1
        assert {r["puzzle_id"] for r in readers.puzzle_ids(spark, str(tmp_path)).collect()} == {"a", "b"}

    def test_label_files(self, spark, tmp_path):
        (tmp_path / "gt.txt").write_text("a.png,3\nb.png,x\nc,d,4\nd.png,12\n")
        (tmp_path / "a.png").write_text("png")  # files without bytes are not listed
        labels = readers.read_labels(spark, str(tmp_path / "gt.txt"))
        assert {(r["file"], r["label"]) for r in labels.collect()} == {("a.png", 3), ("d.png", 12)}
        assert readers.existing_labels(labels, readers.files(spark, str(tmp_path), "*.png")).count() == 1
        listing = frame(spark, [("/x/high/7/cell_r1_c2.png",), ("/x/low/7/a.png",), ("/x/med/no/a.png",)], "path string")
        assert [tuple(r) for r in readers.tiered_cells(listing).collect()] == [("/x/high/7/cell_r1_c2.png", 7, "high")]
        assert [tuple(r)[1:] for r in readers.cell_images(listing).collect()] == [(1, 2)]

    def test_writers(self, spark, tmp_path):
        c = frame(spark, [(1, 0, 0, 5, 0.9), (1, 0, 1, None, 0.0), (1, 1, 0, 3, 0.2)], "puzzle long, row int, col int, number int, confidence double")
        assert '"recognized":2' in writers.diagnostic_json(c).first()["json"]
        assert writers.truth_json(c).first()["json"] == '{"puzzleId":"1","grid":[[5,null],[3]]}'
        report = frame(spark, [("f", "high", 1, 0.9, "1", "1", "keep", "", "note")], "file string, tier string, number int, confidence double, raw_text string, raw_digits string, action string, reason string, note string")
        writers.write_csv_report(report, str(tmp_path / "csv"))
        assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(writers.REPORT_COLUMNS)


class TestKernels:
    def test_small_images(self):
        x = np.zeros((20, 20))
        x[5:15, 8:12] = 200
        assert 0 <= kernels.otsu_threshold(x) < 200 and (kernels.binarise(x) > 0).sum() == 40
        assert (kernels.dilate(x) > 0).sum() == 12 * 6 and (kernels.erode(x) > 0).sum() == 8 * 2
        assert kernels.resize(x, 10, 10).mean() == pytest.approx(x.mean()) and kernels.fit_within(x, 5, 10).shape == (5, 5)
        assert kernels.features(x)[1] == pytest.approx(4 / 10) and kernels.features(x)[4] == 1
        noise = np.random.default_rng(3).uniform(0, 200, (40, 40))
        assert kernels.perceptual_hash(noise) == kernels.perceptual_hash(noise * 1.01) < 1 << 63
        assert kernels.two_valued_share(np.array([[0, 255, 3, 0]])) == 0.75
        for bad in (kernels.gaussian_kernel, kernels.adaptive_threshold):
            with pytest.raises(ValueError):
                bad(*([4] if bad is kernels.gaussian_kernel else [x, 4]))

    def test_period(self):
        x = np.sin(np.arange(400) * 2 * np.pi / 23)
        assert kernels.period_by_autocorrelation(x, 10, 40)[0] == pytest.approx(23, abs=0.3)
        assert np.argmax(kernels.magnitudes(x)) == pytest.approx(1024 / 23, abs=2)

    def test_hamming(self, spark):
        assert frame(spark, [(5, 6)], "a long, b long").select(geometry.hamming(F.col("a"), F.col("b"))).first()[0] == 2

    def test_chains(self, spark, tmp_path):
        r = np.random.default_rng(4)
        page = np.full((60, 80), 200.0)
        page[::15] = page[:, ::20] = 20
        assert set(np.unique(chains.preprocess(page + r.normal(0, 3, page.shape)))) <= {0.0, 255.0}
        faint = 100 + r.uniform(0, 10, (64, 64))
        assert np.ptp(chains.equalise(faint, 3.0)) > 3 * np.ptp(faint) and chains.equalise(np.zeros((9, 5))).shape == (9, 5)
        noisy = page + r.normal(0, 8, page.shape)
        assert np.abs(chains.denoise(noisy) - page).mean() < np.abs(noisy - page).mean()
        assert np.allclose(chains.rotate(chains.rotate(page, 90)[10:50, 20:60], -90)[5:-5, 5:-5], chains.rotate(chains.rotate(page, 90)[10:50, 20:60], 270)[5:-5, 5:-5])
        tilted = np.zeros((80, 80))
        tilted[38:42, 10:70] = 255
        for angle in (7, -7):
            assert abs(kernels.skew_angle(chains.deskew(chains.rotate(tilted, angle)))) < 1
        for prepared in chains.STRATEGIES.values():
            out = prepared(page[:30, :20])
            assert out.shape == (128 + 2 * 38, 85 + 2 * 25) and out[0].max() == 0
        assert chains.dark_background(np.full((3, 3), 255.0)).max() == 0
        marks = np.zeros((20, 20))
        marks[2:4, 2:4] = marks[8:17, 10:15] = 255
        assert chains.symbol_box(marks) == (8, 10, 9, 5) and chains.symbol_box(marks * 0) is None
        assert chains.crop_symbol(marks, (8, 10, 9, 5)).shape == (17, 15) and chains.normalise_symbol(marks[8:17, 10:15]).sum() == pytest.approx(255 * 64 * 36)
        assert [c.shape[1] for c in chains.columns(page, [0, 20, 50])] == [20, 30] and chains.symbol_of(np.full((20, 20), 255.0)) is None
        image = spark.createDataFrame([(("a", 20, 40, 1, 0, bytes(np.hstack([255 - marks, np.full((20, 20), 255.0)]).astype(np.uint8).tobytes())),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
        assert [(x["row"], x["col"]) for x in chains.cell_symbols(image, 1, 2, first_col=0).collect()] == [(0, 0)]

    def test_peaks_and_periods(self):
        line = np.zeros(200)
        line[[10, 30, 50, 110, 130, 150]] = 10
        assert chains.fill_by_median_gap(chains.local_peaks(line, 5)) == [10, 30, 50, 70, 90, 110, 130, 150]
        assert chains.borders_by_period(line, 20) == [10, 30, 50, 70, 90, 110, 130, 150] and chains.borders_by_period(line * 0, 20) == []
        assert chains.positions_by_peaks(line, 10) == [0, 10, 30, 50, 110, 130, 150, 200] and chains.positions_by_peaks(line[:40], 30) == []
        wave = np.sin(np.arange(400) * 2 * np.pi / 23)
        assert chains.dominant_period(wave, 10, 40)[0] == pytest.approx(23, abs=0.5)
        assert chains.dominant_period(wave, 10, 40, least_snr=1e9)[0] == pytest.approx(23, abs=0.7)
        with pytest.raises(ValueError):
            chains.dominant_period(wave, 500, 501, least_snr=1e9)

    def test_bank_is_the_plain_loop(self, spark):
        """The bank of templates against a loop over cells."""
        r = np.random.default_rng(6)
        looks = {n: r.uniform(0, 1, 12) for n in (2, 12, 26, 7)}
        rows = [(1, i, n, float(r.uniform(0, 1)), np.clip(looks[26 if n in (2, 12) and i % 2 else n] + r.normal(0, 0.05, 12), 0, 1).tolist()) for i, n in enumerate(r.choice([2, 12, 26, 7], 60).tolist())]
        got = {x["ord"]: (x["number"], round(x["confidence"], 9), x["template"]) for x in templates.build_bank(frame(spark, rows, "puzzle long, ord long, number int, confidence double, pixels array<double>")).collect()}
        bank, alike = {}, lambda a, b: 1 - np.abs(np.subtract(a, b)).mean()
        for _, i, n, conf, pixels in rows:
            if n in (2, 12) and conf < 0.4 and len(bank.get(26, [])) >= 2 and max(alike(pixels, t) for t in bank[26]) > 0.8:
                n, conf = 26, max(alike(pixels, t) for t in bank[26])
            own = bank.setdefault(n, [])
            keep = conf >= 0.5 and len(own) < 3 and not any(alike(pixels, t) >= 0.85 for t in own)
            if keep:
                own.append(pixels)
            assert got[i] == (n, round(conf, 9), keep)

    def test_helpers_of_cells(self, spark):
        from pyspark.sql import Observation

        c = frame(spark, [(1, 0, i, i if i % 2 else None, 0.5) for i in range(20)], "puzzle long, row int, col int, number int, confidence double")
        seen = Observation("progress")
        assert cells.with_progress(c, seen).count() == 20 and seen.get == {"processed": 20, "recognized": 10}
        m = frame(spark, [(1, i, 0 if i < 4 else 1, float(10 + 90 * (i == 3)), 1.0, [0.0] * 7) for i in range(6)], "puzzle long, ord long, cluster int, area double, aspect_ratio double, moments array<double>")
        parts = {x["ord"]: x["cluster"] for x in clusters.split_clusters(m, frame(spark, [(1, 0)], "puzzle long, cluster int")).collect()}
        assert parts == {0: 2, 1: 2, 2: 2, 3: 3, 4: 1, 5: 1}


def test_segments_of_a_nation_all_cross(spark):
    """Every customer's line meets every supplier's of its nation, wherever their keys lie."""
    count = lambda t, k: {r[k]: r["count"] for r in spark.read.parquet(f"{SF}/{t}.parquet").groupBy(k).count().collect()}
    c, s = count("customer", "c_nationkey"), count("supplier", "s_nationkey")
    crossed = registry.QUERIES["segment_cross"](spark, SF).count()
    assert crossed == sum(n * s.get(k, 0) for k, n in c.items())


def test_crossings_are_compiled(spark):
    """What is done for each pair is short enough for Java's compiler (8,000 bytes of code; 12,370 before), and its copies are not made where the lines meet."""
    lines = [(k, (0.0, float(y), 1000.0, float(y + y % 3)), "horizontal") for k in (1, 2) for y in (3, 3, 3, 4, 8)] + [(k, (float(x), 0.0, float(x + x % 5), 1000.0), "vertical") for k in (1, 3) for x in (7, 7, 13)]
    table = frame(spark, lines, "k int, line struct<x1: double, y1: double, x2: double, y2: double>, kind string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = signal.intersections(table, "k", 1000, 1000, 6)
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
        stages = [stages.apply(i) for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(x._3().maxMethodCodeSize() for x in stages) < 8000
    assert steps_of(found).count("CollectMetrics") == 2
    want = []
    for k, (_, y1, _, y2), _ in lines[:5]:
        for x in (7, 7, 13):
            t = (1000 * x + y1 * (x % 5)) / (1e6 - (y1 - y2) * -(x % 5))
            want.append((k, round(t * 1000, 6), round(y1 + t * (y2 - y1), 6)))
    got = sorted(map(tuple, found.collect()))
    assert [g[0] for g in got] == [1] * 15 and np.allclose(got, sorted(want), atol=2e-6)
    assert len(set(got)) == 6


@given(st.lists(st.one_of(st.floats(), st.floats(-1000, 1000), st.integers(-(10**9), 10**9).map(lambda n: n / 2e6), st.integers(-(10**9), 10**9).map(lambda n: n / 1e6)), min_size=200, max_size=400))
@settings(max_examples=5, deadline=None)
def test_rounded_is_round(spark, numbers):
    table = frame(spark, [(x,) for x in [*numbers, None, float("nan"), float("inf"), -0.0, -1e-9, 0.5, 2.5e-6, 1e6, -999999.9999995]], "x double")
    rows = table.select(*[c.alias(f"c{i}") for n in (0, 2, 6) for i, c in enumerate((digits.rounded("x", n), F.round("x", n)))]).collect()
    assert all(repr(r[i]) == repr(r[i + 1]) for r in rows for i in (0, 2, 4))


def test_dealt_pairs(spark):
    one = frame(spark, [(k, i % 3) for k, n in ((1, 40), (2, 1), (3, 5)) for i in range(n)], "k int, a int")
    other = frame(spark, [(k, i) for k, n in ((1, 7), (2, 3), (4, 2)) for i in range(n)], "k int, b int")
    for parts_ in (1, 5):
        assert sorted(map(tuple, signal.dealt_pairs(one, other, "k", parts_).collect())) == sorted(map(tuple, one.join(other, "k").collect()))


def test_long_lines_of_a_nation_all_cross(spark):
    """Customers of one nation whose keys lie far from a supplier's meet it all the same."""
    sf = "/root/testdata/sf0.01"
    long = spark.read.parquet(f"{sf}/customer.parquet").where("hypot(c_custkey % 700, c_custkey % 7) >= 300").groupBy("c_nationkey").count()
    c, s = ({r[0]: r[1] for r in t.collect()} for t in (long, spark.read.parquet(f"{sf}/supplier.parquet").groupBy("s_nationkey").count()))
    points = {r["k"]: r["points"] for r in registry.QUERIES["extended_lines"](spark, sf).collect()}
    assert points == {k: n * s[k] for k, n in c.items() if k in s}


def steps_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_grids_are_found_where_their_photos_are(spark, tmp_path):
    """No point, and no table to broadcast, leaves a task: only lines do."""
    rows = [(f"p{i}.png", 3 + i, 4 + i, [(0, 0)]) for i in range(3)]
    drawn = pictures.draw_grids(frame(spark, rows, "name string, rows int, cols int, marks array<struct<i: int, j: int>>"), 6, 5)
    images.write_images(drawn, f"{tmp_path}/g").collect()
    found = pictures.detected_grids(pictures.axis_lines(images.read_images(spark, f"file://{tmp_path}/g")))
    assert "Join" not in steps_of(found)
    got = sorted((r["rows"], r["cols"], r["left"], r["top"], r["right"], r["bottom"]) for r in found.collect())
    assert got == [(3 + i, 4 + i, 5.0, 5.0, 5.0 + 6 * (4 + i), 5.0 + 6 * (3 + i)) for i in range(3)]


def test_photos_are_held_a_few_at_a_time(spark):
    """A task's photos are not one batch (192 MB of these before), and their lines stay in the photo's row."""

    class Grids:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    marks = [{"i": i, "j": i % 7} for i in range(0, 90, 3)]
    rows = pa.RecordBatch.from_pylist([{"name": f"photo-{k}.png", "rows": 96 - k % 5, "cols": 7, "marks": marks[: k % 31]} for k in range(3000)])
    tracemalloc.start()
    try:
        drawn = sum(b.num_rows for b in pictures.draw_grids(Grids(), 6, 5)(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert drawn == 3000 and peak < 20_000_000
    ((width, pixels),) = {tuple(x) for b in pictures.draw_grids(Grids(), 6, 5)(iter([rows.slice(30, 1)])) for x in zip(b.column("width").to_pylist(), b.column("pixels").to_pylist())}
    dark = np.argwhere(np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width) == 20).tolist()
    assert sorted(dark) == [[y, x] for y in range(5, 582) for x in range(5, 48) if (y - 5) % 6 == 0 or (x - 5) % 6 == 0 or any(y - 8 - 6 * m["i"] in (0, 1) and x - 8 - 6 * m["j"] in (0, 1) for m in marks)]
    read = spark.createDataFrame([], "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    assert not any(step in steps_of(pictures.detected_grids(pictures.axis_lines(read))) for step in ("Exchange", "Aggregate", "Generate", "Join"))


def test_votes_are_counted_where_a_keys_points_meet(spark):
    r = random.Random(6)
    points = [(k, r.randrange(-9, 12), r.randrange(15)) for k, n in ((1, 70), (2, 3), (None, 25), (3, 200)) for _ in range(n)]
    lines = pictures.voted_lines(frame(spark, points, "k long, x long, y long").repartition(3), "k", 12, 3, 2)
    assert "Join" not in steps_of(lines) and "Generate" not in steps_of(lines)
    votes = {}
    for k, x, y in points:
        for t, c, s in pictures.angle_table(12):
            at = (k, t, math.floor(x * c + y * s + 0.5))
            votes[at] = votes.get(at, 0) + 1
    votes = {at: n for at, n in votes.items() if n >= 3}
    rank = lambda at: (votes[at], -at[1], -at[2])
    want = {at for at in votes if not any(o[0] == at[0] and abs(o[1] - at[1]) <= 2 and abs(o[2] - at[2]) <= 2 and rank(o) > rank(at) for o in votes)}
    assert {(x["k"], x["angle"], x["rho"]): x["votes"] for x in lines.collect()} == {at: votes[at] for at in want}


def test_signals_meet_once(spark):
    """Neither lags, frequencies nor places of a kernel are rows of a shuffle or a join."""
    s = frame(spark, [("a", i, float(i % 24 == 5) + i % 3, 200) for i in range(200)], "key string, i long, x double, n long")
    for found in (spectrum.magnitudes(s, "key", 6, 48), spectrum.dominant_period(s, "key", 6, 48), spectrum.borders_by_period(s, "key", 24), spectrum.positions_by_peaks(s, "key", 12), spectrum.smooth(s, "key", 2.5), spectrum.local_peaks(s, "key", 6, 2.5)):
        steps = steps_of(found)
        assert not any(step in steps for step in ("Join", "Union", "Window")) and "Generate" not in steps.split("MapInArrow")[1] and steps.count("Aggregate") <= 2
        assert found.count() > 0


def test_a_batch_is_compared_once(spark, monkeypatch):
    """The report and the results read the comparison's file, not the tables again."""
    from cellweave.plans import files

    seen, write = [], writers.write_batch
    monkeypatch.setattr(writers, "write_batch", lambda metrics, report, path: (seen.extend(x.inputFiles() for x in (metrics, report)), write(metrics, report, path)))
    assert files.batch_files(spark, SF).count() == 1
    assert len(seen) == 2 and not any("lineitem" in f for x in seen for f in x)
