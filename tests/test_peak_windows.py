"""Peaks as the SQL finds them, also where places repeat, lack or are negative."""

from fieldtrace.operators import pixels


def test_peaks(spark):
    data = [("A", i * 7 % 9 - 2, i * 5 % 8 - 3, float(i * 37 % 11)) for i in range(60)] + [("A", 3, 3, 12.0)] * 2 + [("B", 0, 0, 5.0), ("B", 0, 2, 5.0), ("B", 2, 1, 5.0)]
    beats = lambda b, a: b[3] > a[3] or b[3] == a[3] and b[1:3] < a[1:3]
    for d in (1, 2):
        want = [a for a in data if a[3] > 4 and not any(b[0] == a[0] and abs(b[1] - a[1]) <= d and abs(b[2] - a[2]) <= d and beats(b, a) for b in data)]
        got = pixels.peaks(spark.createDataFrame(data, "image string, row int, col int, value double"), d, 4)
        assert sorted(map(tuple, got.collect())) == sorted(want)
