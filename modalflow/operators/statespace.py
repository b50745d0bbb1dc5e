"""State-space operators: one task per series runs the recursion along time; series scale out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.functions import kernels as k

BUNDLE = "series string, kind string, name string, t int, i int, value double"


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """(t, dim, v) rows to time by dimension; what is missing is NaN."""
    return pdf.pivot_table(index="t", columns="dim", values="v", aggfunc="first", dropna=False).sort_index().to_numpy(float)


def bundle(signal: DataFrame, horizon: int = 12, smoother: str = "koopman") -> DataFrame:
    """Fit, filter, impulse responses and smoother of each series (series, dim, t, v) as rows (series, kind, name, t, i, value).

    A series that can't be fitted gives one row of kind `error`; the others go on.
    """
    if smoother not in ("koopman", "rts"):
        raise ValueError("the smoother is koopman or rts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf["series"].iloc[0]
        rows: list[tuple] = []
        try:
            y = _matrix(pdf)
            m = k.fit_var(y[np.isfinite(y).all(1)])
            f = k.kalman(m, y)
            s, p = k.koopman(m, y, f) if smoother == "koopman" else k.rts(m, f)
            inn = f.innovation[np.isfinite(f.innovation)]
            diag = m.diagnostics() | {
                "log_likelihood": float(f.loglik.sum()), "mean_log_likelihood": float(f.loglik.mean()), "innovation_rmse": float(np.sqrt((inn**2).mean())),
                "mean_filtered_trace": float(np.trace(f.cov, axis1=1, axis2=2).mean()), "mean_smoothed_trace": float(np.trace(p, axis1=1, axis2=2).mean()),
            }
            diag |= k.smoother_summary(m, s, p)
            rows += [("diag", n, 0, 0, v) for n, v in diag.items()]
            rows += [("system", n, int(a), int(b), float(x)) for n in "TQE" for (a, b), x in np.ndenumerate(getattr(m, n))]
            rows += [("filter", "state", t, i, float(v)) for (t, i), v in np.ndenumerate(f.state)] + [("filter", "loglik", t, 0, float(v)) for t, v in enumerate(f.loglik)]
            rows += [("smooth", "state", t, i, float(v)) for (t, i), v in np.ndenumerate(s)]
            rows += [("smooth", n, t, i, float(v)) for n, x in (("shock", k.shocks(m, s)), ("observable", k.observables(m, s))) for (t, i), v in np.ndenumerate(x)]
            rows += [("irf", f"shock_{j}", h, i, float(v)) for j in range(m.R.shape[1]) for (h, i), v in np.ndenumerate(k.impulse(m, horizon, j))]
        except (ValueError, np.linalg.LinAlgError) as err:
            rows = [("error", str(err)[:200], 0, 0, float("nan"))]
        out = pd.DataFrame(rows, columns=["kind", "name", "t", "i", "value"])
        out.insert(0, "series", series)
        return out

    return signal.groupBy("series").applyInPandas(run, BUNDLE)


def draws(signal: DataFrame, n: int, blocks: int = 4, seed: int = 0, method: str = "durbin_koopman") -> DataFrame:
    """Posterior paths (series, draw, t, i, value): blocks of draws of one series are tasks of their own."""
    if method not in ("durbin_koopman", "carter_kohn"):
        raise ValueError("the method is durbin_koopman or carter_kohn")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series, block = pdf["series"].iloc[0], int(pdf["block"].iloc[0])
        y = _matrix(pdf)
        m = k.fit_var(y[np.isfinite(y).all(1)])
        f = k.kalman(m, y)
        rng = np.random.default_rng(np.random.SeedSequence([seed, block, *series.encode()]))
        out = []
        for d in range(block, n, blocks):
            path = k.durbin_koopman(m, y, rng) if method == "durbin_koopman" else k.carter_kohn(m, f, rng)
            out += [(series, d, t, i, float(v)) for (t, i), v in np.ndenumerate(path)]
        return pd.DataFrame(out, columns=["series", "draw", "t", "i", "value"])

    spread = signal.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.groupBy("series", "block").applyInPandas(run, "series string, draw int, t int, i int, value double")


def bands(paths: DataFrame, level: float = 0.9) -> DataFrame:
    """series, t, i, mean, lo, hi of the draws."""
    tail = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return paths.groupBy("series", "t", "i").agg(F.avg("value").alias("mean"), q.alias("q")).select("series", "t", "i", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def chandrasekhar(signal: DataFrame) -> DataFrame:
    """series, t, loglik by the small-matrix recursion and, beside it, by the filter from the same stationary start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _matrix(pdf)
        m = k.fit_var(y)
        s, p = k.stationary(m)
        # The filter predicts first: its start is the stationary law, which one step leaves as it is.
        full = k.kalman(m, y, s, p)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "t": range(len(y)), "loglik": k.chandrasekhar(m, y), "kalman": full.loglik})

    return signal.groupBy("series").applyInPandas(run, "series string, t int, loglik double, kalman double")


def particles(signal: DataFrame, n: int = 1000, seed: int = 0, **options) -> DataFrame:
    """series, t, loglik, mean, ess, stages, acceptance of a tempered particle filter on each series' fitted system."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf["series"].iloc[0]
        y = _matrix(pdf)
        m = k.fit_var(y[np.isfinite(y).all(1)])
        r = k.particle_filter(k.linear_as_nonlinear(m), y, np.zeros(len(m.T)), n, int(np.random.SeedSequence([seed, *series.encode()]).generate_state(1)[0]), **options)
        return pd.DataFrame({"series": series, "t": range(len(y)), "loglik": r["loglik"], "mean": r["mean"][:, 0], "ess": r["ess"], "stages": r["stages"], "acceptance": r["acceptance"]})

    return signal.groupBy("series").applyInPandas(run, "series string, t int, loglik double, mean double, ess double, stages int, acceptance double")


def wavelet(signal: DataFrame, fs: float, ratio: float = 0.1) -> DataFrame:
    """series, method, rank, freq, magnitude, confidence of each series' Morlet spectrum."""
    return _detected(signal, "wavelet", fs, ratio)


def _detected(signal: DataFrame, method: str, fs: float, ratio: float) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = k.detect(pdf.sort_values("t")["v"].to_numpy(float), method, fs, ratio)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "method": d.method, "rank": range(1, len(d.freq) + 1), "freq": d.freq, "magnitude": d.magnitude, "confidence": d.confidence})

    return signal.groupBy("series").applyInPandas(run, "series string, method string, rank int, freq double, magnitude double, confidence double")


def detected(signal: DataFrame, method: str, fs: float, ratio: float = 0.1) -> DataFrame:
    """As `wavelet`, by any method: the way for series too long for sums over bins."""
    return _detected(signal, method, fs, ratio)


def scalogram(signal: DataFrame, fs: float, most: int = 8_000_000) -> DataFrame:
    """series, bin, freq, t, power; none for a series whose scalogram has more than `most` cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["v"].to_numpy(float)
        if len(x) < 16 or 96 * len(x) > most:
            return pd.DataFrame({"series": [], "bin": [], "freq": [], "t": [], "power": []})
        f, _, p = k.morlet(x, fs)
        b, t = np.indices(p.shape)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "bin": b.ravel(), "freq": f[b.ravel()], "t": t.ravel(), "power": p.ravel()})

    return signal.groupBy("series").applyInPandas(run, "series string, bin int, freq double, t int, power double")


def persistence(signal: DataFrame, states: int = 4, least: float = k.PERSISTENT, how: str = "kmeans") -> DataFrame:
    """series, state, stay, stationary, persistent: states by k-means or quantile, by level, and how likely each is kept."""
    if how not in ("kmeans", "quantile"):
        raise ValueError("states come by kmeans or quantile")
    of = k.kmeans_states if how == "kmeans" else k.quantile_states

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, pi = k.markov_chain(of(pdf.sort_values("t")["v"].to_numpy(float), states), states)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "state": range(states), "stay": np.diag(p), "stationary": pi, "persistent": np.diag(p) > least})

    return signal.groupBy("series").applyInPandas(run, "series string, state int, stay double, stationary double, persistent boolean")
