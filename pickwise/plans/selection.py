"""End-to-end selection run: normalise -> fill -> binarise -> fit -> score -> choose -> report.

Physical shape: the score table is read once per pass; the normaliser and
the model each need one aggregate pass whose output is a single row
(broadcast).  Per-problem metrics are hash aggregates on ``problem_id``
(partial aggregation, no ranking window, no sort), all three metric groups in
one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import written
from pickwise.models.logistic import logistic_fit, logistic_score
from pickwise.models.naive_bayes import nb_fit, nb_score
from pickwise.operators import groups as G
from pickwise.operators import neighbors as NB
from pickwise.operators import sampling as SP
from pickwise.operators import scores as S
from pickwise.operators import verifiers as V
from pickwise.operators.metrics import problem_results, summary, summary_by_difficulty
from pickwise.operators.scores import binarize_fixed, fill_missing, minmax_all


def weak_votes(scores: DataFrame, verifiers, threshold: float = 0.5) -> DataFrame:
    """Normalise (gated min-max), fill missing with 0, binarise at ``threshold``."""
    n = minmax_all(scores, verifiers)
    n = fill_missing(n, verifiers, 0)
    return binarize_fixed(n, verifiers, threshold)


def naive_bayes_selection(scores: DataFrame, verifiers, threshold: float = 0.5,
                          set_name: str = "train", persist: bool = True) -> DataFrame:
    """Per-problem results of a naive Bayes selection run (train = test = all problems).

    The run makes three dependent passes (normaliser statistics, model fit, scoring), so
    the narrow score table (ids, y and the V verifier columns) is persisted once
    (MEMORY_AND_DISK: lost blocks are recomputed from lineage)."""
    base = scores.select("problem_id", "sample_idx", "y", *verifiers)
    if persist:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    votes = weak_votes(base, verifiers, threshold)
    params = nb_fit(votes, verifiers)
    scored = nb_score(votes, params, verifiers)
    return problem_results(scored, "p1").withColumn("set", F.lit(set_name))


def selection_summary(scores: DataFrame, verifiers, threshold: float = 0.5) -> DataFrame:
    return summary(naive_bayes_selection(scores, verifiers, threshold))


@dataclass(frozen=True)
class RunConfig:
    """One selection run.

    model: naive_bayes | logistic | label_model | gaussian | mixture | triplet | naive_ensemble | majority_vote | first_sample
    model_class: per_dataset (one model; the only one of mixture and triplet) | cluster (one per cluster) |
        per_problem (not for label_model, which would run one fit after the other)
    clusters: difficulty | binned_difficulty | answers | random | kmeans | gmm | hierarchical | spectral, into ``n_clusters``
        parts, density, or map (text files with JSON objects {problem: cluster} at ``cluster_path``); the fitted ones
        group the problems' mean scores
    normalize: minmax_all | minmax_per_problem | winsorize | quantile | None;  calibrate: None | isotonic | sigmoid, after it
    missing: zero | mean;  binarize: fixed | class_balance | per_problem | per_cluster | None
    drop_imbalanced: None | all | small | large | adaptive;  drop_dependent: density of pairs whose second verifier goes
    class_balance: None (estimated) | "labels" | a number, for the label model
    train_split 1 means train = test = all problems; train_queries and train_samples below 1 are shares."""
    model: str = "naive_bayes"
    model_class: str = "per_dataset"
    clusters: str = "difficulty"
    n_clusters: int = 2
    train_split: float = 1.0
    train_queries: float = 1
    train_samples: float = 1
    normalize: str | None = "minmax_all"
    missing: str = "zero"
    binarize: str | None = "fixed"
    threshold: float = 0.5
    majority_as_verifier: bool = False
    drop_imbalanced: str | None = None
    drop_dependent: float = 0
    class_balance: float | str | None = None
    seed: int = 42
    bins: int = 10
    answer: str = "answer"
    calibrate: str | None = None
    cluster_path: str | None = None


GROUPED = ("naive_bayes", "logistic", "label_model", "gaussian")
SINGLE = ("mixture", "triplet")


def prepare_scores(base: DataFrame, verifiers, cfg: RunConfig, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(filled scores, votes) by the configured normaliser, missing rule and binariser."""
    norm = {None: lambda d, v: d, "minmax_all": S.minmax_all, "minmax_per_problem": S.minmax_per_problem,
            "winsorize": S.winsorize, "quantile": S.quantile_norm}[cfg.normalize](base, verifiers)
    if cfg.calibrate:
        norm = {"isotonic": S.calibrate_isotonic, "sigmoid": S.calibrate_sigmoid}[cfg.calibrate](norm, verifiers)
    filled = S.fill_missing(norm, verifiers, 0 if cfg.missing == "zero" else "mean")
    filled = filled.drop("fill_fallback")
    if cfg.binarize is None:
        return filled, filled
    if cfg.binarize == "fixed":
        votes = S.binarize_fixed(filled, verifiers, cfg.threshold)
    elif cfg.binarize == "class_balance":
        votes = S.binarize_class_balance(filled, verifiers)
    elif cfg.binarize == "per_problem":
        votes = S.binarize_per_problem(filled, verifiers)
    elif cfg.binarize == "per_cluster":
        votes = S.binarize_per_cluster(filled.join(clusters, "problem_id"), verifiers).drop("cluster_id")
    else:
        raise ValueError(f"unknown binariser {cfg.binarize}")
    return filled, votes


FITTED_CLUSTERS = {"kmeans": G.cluster_kmeans, "gmm": G.cluster_gmm, "hierarchical": G.cluster_hierarchical, "spectral": G.cluster_spectral}


def cluster_problems(base: DataFrame, cfg: RunConfig, verifiers=()) -> DataFrame:
    """(problem_id, cluster_id) of all problems."""
    if cfg.clusters == "binned_difficulty":
        return G.cluster_binned_difficulty(base, cfg.n_clusters)
    if cfg.clusters == "map":
        return G.cluster_map(base.sparkSession.read.text(cfg.cluster_path), base)
    if cfg.clusters == "density" or cfg.clusters in FITTED_CLUSTERS:
        means = NB.mean_vectors(S.fill_missing(base, list(verifiers), 0), verifiers).withColumnRenamed("vec", "embedding")
        if cfg.clusters == "density":
            return G.cluster_density(means)
        return FITTED_CLUSTERS[cfg.clusters](means, cfg.n_clusters).select("problem_id", "cluster_id")
    if cfg.clusters == "difficulty":
        return G.cluster_difficulty(base, cfg.n_clusters)
    if cfg.clusters == "answers":
        return G.cluster_answer_count(base, cfg.n_clusters, answer=cfg.answer).select("problem_id", "cluster_id")
    if cfg.clusters == "random":
        return G.cluster_random(base, cfg.n_clusters, cfg.seed)
    raise ValueError(f"unknown clusters {cfg.clusters}")


def kept_verifiers(train_votes: DataFrame, verifiers, cfg: RunConfig) -> list[str]:
    """Verifiers left after the imbalance and dependency rules (V rows reach the driver)."""
    left = list(verifiers)
    if cfg.drop_imbalanced:
        kept = {r["verifier"] for r in V.drop_imbalanced(train_votes, left, cfg.drop_imbalanced, fallback=True).where("kept").collect()}
        left = [v for v in left if v in kept]
    if cfg.drop_dependent and len(left) > 2:
        gone = {r["vj"] for r in V.dependency_pairs(train_votes, left, cfg.drop_dependent).collect()}
        left = [v for v in left if v not in gone] or left
    return left


def _fit_score(model: str, train: DataFrame, asked: dict[str, DataFrame], verifiers, cfg: RunConfig, group: str | None):
    """{set: rows with p1}: one fit per model (or group), used for every set.

    Label models use no labels: where the asked rows are not the train rows they are fitted on those."""
    if model == "naive_bayes":
        params = nb_fit(train, verifiers, group_col=group).checkpoint()
        return {k: nb_score(d, params, verifiers, group_col=group) for k, d in asked.items()}
    if model == "logistic":
        params = logistic_fit(train, verifiers, group_col=group)
        return {k: logistic_score(d, params, verifiers, group_col=group) for k, d in asked.items()}
    if model == "gaussian":
        from pickwise.models.gaussian import gmm_fit, gmm_predict
        start = train.withColumn("__init", F.col("y").cast("int"))
        params = gmm_fit(start, list(verifiers), 2, group, reg=0.01, max_iter=50, tol=1e-4, start="two_means")
        return {k: gmm_predict(d, params, list(verifiers), group, out="p1", prob_of=1) for k, d in asked.items()}
    if model == "mixture":
        from pickwise.models.mixture import mixture_fit, mixture_score
        fitted = mixture_fit(train, verifiers)
        return {k: mixture_score(d, fitted) for k, d in asked.items()}
    if model == "triplet":
        from pickwise.models.moments import triplet_fit, triplet_score
        return {k: triplet_score(d, triplet_fit(train if k == "train" or cfg.train_split >= 1 else d, verifiers), verifiers) for k, d in asked.items()}
    from pickwise.models.label_model import label_model_fits, label_model_score
    balance = cfg.class_balance
    if balance == "labels":
        labelled = train.select(F.lit(None).alias("g") if group is None else F.col(group).alias("g"), "y")
        balance = {r["g"]: r["cb"] for r in labelled.groupBy("g").agg(F.avg("y").alias("cb")).collect()}  # clusters: a parameter's number
    fits = lambda rows: label_model_fits(rows, verifiers, balance, group)
    own = fits(train)
    out = {}
    for k, d in asked.items():
        params = own if k == "train" or cfg.train_split >= 1 else fits(d)
        parts = [label_model_score(d if group is None else d.where(F.col(group) == F.lit(g)), params[g], verifiers) for g in params if g in own]
        out[k] = reduce(DataFrame.unionByName, parts)
    return out


def run(scores: DataFrame, verifiers, cfg: RunConfig, fixed_test: DataFrame | None = None):
    """split -> normalise -> fill -> binarise -> drop verifiers -> fit once on train -> route and score train
    and test -> per-problem results -> (results, summary, summary by difficulty).

    ``fixed_test`` (problem_id): these problems are the test set whatever the split, and never train.
    Results carry the model used (``model_id``: cluster or train problem; null for one model) and the
    distance of the mean scores to the train problem behind the choice.  Problems whose model could not be
    trained (one label class) use the nearest train problem with a trained model; train problems without
    a model of their own are left out, as there is nothing to report."""
    if cfg.model_class != "per_dataset" and cfg.model in SINGLE or cfg.model_class == "per_problem" and cfg.model == "label_model":
        raise ValueError(f"{cfg.model} has no models by {cfg.model_class}")
    verifiers = list(verifiers)
    columns = ["problem_id", "sample_idx", "y", *verifiers] + ([cfg.answer] if cfg.answer in scores.columns else [])
    base = scores.select(*columns)
    if cfg.majority_as_verifier:
        base = S.majority_verifier(base, cfg.answer)
        verifiers.append("mv_verifier")
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    split = SP.stratified_split(base, cfg.train_split, cfg.seed, cfg.bins)
    if cfg.train_queries != 1:
        split = SP.train_queries(split, cfg.train_queries, cfg.seed)
    if fixed_test is not None:
        split = SP.with_fixed_test(split, fixed_test, SP.difficulty_bins(base, cfg.bins))
    split = written(split, "split")
    # train = test = all problems: both sets have the same rows and scores
    whole = cfg.train_split >= 1 and cfg.train_queries == 1 and fixed_test is None
    sets = ("test",) if whole else ("train", "test")
    clusters = written(cluster_problems(base, cfg, verifiers), "clusters") if "cluster" in (cfg.model_class, (cfg.binarize or "")[4:]) else None
    filled, votes = prepare_scores(base, verifiers, cfg, clusters)

    def of(df, name):
        return df.join(split.where(F.col("set") == name).select("problem_id"), "problem_id", "left_semi")

    train_votes = of(votes, "train")
    if cfg.train_samples != 1:
        train_votes = SP.subsample_samples(train_votes, cfg.train_samples, cfg.seed)
    verifiers = kept_verifiers(train_votes, verifiers, cfg)
    routes = None
    if cfg.model in GROUPED + SINGLE:
        source, train = votes, train_votes
        if cfg.model in ("logistic", "gaussian", "mixture", "triplet") and cfg.binarize == "fixed":
            source = filled  # these models read scores, not votes
            train = of(filled, "train").join(train_votes.select("problem_id", "sample_idx"), ["problem_id", "sample_idx"], "left_semi")
        if cfg.model_class == "per_dataset":
            scored = _fit_score(cfg.model, train, {n: of(source, n) for n in sets}, verifiers, cfg, None)
        else:
            routes = route_groups(base, filled, split, clusters, train, verifiers, cfg)
            own = train.join(_group_of(clusters, train), "problem_id")
            asked = {n: of(source, n).join(routes.where(F.col("set") == n).select("problem_id", "__group"), "problem_id") for n in sets}
            if cfg.model == "label_model":  # read once by each sum of the fit and once by each group
                own, asked = written(own, "grouped"), {n: written(d, "asked") for n, d in asked.items()}
            scored = _fit_score(cfg.model, own, asked, verifiers, cfg, "__group")
    else:
        scored = {n: _unfitted(cfg, of(filled, n), verifiers) for n in sets}
    if whole:
        results = written(problem_results(scored["test"], "p1"), "results").withColumn("set", F.explode(F.array(F.lit("train"), F.lit("test"))))
    else:
        results = reduce(DataFrame.unionByName, [problem_results(s, "p1").withColumn("set", F.lit(n)) for n, s in scored.items()])
    results = results.join(split.select("problem_id", "set", "difficulty"), ["problem_id", "set"])
    if routes is None:
        results = results.withColumns({"model_id": F.lit(None).cast("bigint"), "distance": F.lit(None).cast("double")})
    else:
        results = results.join(routes.select("problem_id", "set", F.col("__group").cast("bigint").alias("model_id"), "distance"), ["problem_id", "set"])
    return results, summary(results), summary_by_difficulty(results)


def _group_of(clusters: DataFrame | None, rows: DataFrame) -> DataFrame:
    if clusters is None:
        return rows.select("problem_id", F.col("problem_id").alias("__group")).distinct()
    return clusters.select("problem_id", F.col("cluster_id").alias("__group"))


def route_groups(base, filled, split, clusters, train, verifiers, cfg: RunConfig) -> DataFrame:
    """(problem_id, set, __group, distance): the trained model that each problem uses.

    A problem whose own group (itself, or its cluster) has a trained model uses that; any other test problem
    takes the group of the nearest train problem with a trained model."""
    own = _group_of(clusters, base)
    grouped = train.join(own, "problem_id")
    labels = grouped.groupBy("__group").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    needs_two = cfg.model in ("naive_bayes", "logistic", "gaussian")
    trained = written((labels.where("lo <> hi") if needs_two else labels).select("__group"), "trained")
    train_ids = split.where("set = 'train'").select("problem_id").join(own, "problem_id").join(trained, "__group")
    asked = split.select("problem_id", "set").join(own, "problem_id")
    direct = asked.join(trained, "__group", "left_semi")
    lost = asked.where("set = 'test'").join(trained, "__group", "left_anti").select("problem_id", "set")
    means = written(NB.mean_vectors(filled, verifiers), "means")
    if clusters is None:
        near = direct.select("problem_id", "set", "__group", F.lit(0.0).alias("distance"))
    else:
        # a train problem with a model of its own cluster is its own nearest; only the others search
        learned = direct.where("set = 'train'").select("problem_id").distinct()
        te = means.join(direct.select("problem_id").distinct(), "problem_id", "left_semi").join(learned, "problem_id", "left_anti")
        tr = means.join(train_ids.select("problem_id"), "problem_id", "left_semi")
        inside = G.nearest_in_cluster(te, tr, clusters, clusters, 1).select(F.col("test_id").alias("problem_id"), "distance")
        itself = means.join(learned, "problem_id", "left_semi").where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).select("problem_id", F.lit(0.0).alias("distance"))
        near = direct.join(inside.unionByName(itself), "problem_id", "left").select("problem_id", "set", "__group", "distance")
    far = G.route_model(means.join(lost.select("problem_id"), "problem_id", "left_semi"), means, train_ids.select("problem_id"))
    far = (far.join(train_ids.select(F.col("problem_id").alias("model_id"), "__group"), "model_id")
           .withColumn("set", F.lit("test")).select("problem_id", "set", "__group", "distance"))
    return written(near.unionByName(far), "routes")


def _unfitted(cfg: RunConfig, rows: DataFrame, verifiers) -> DataFrame:
    """p1 of the models that learn nothing."""
    from pickwise.models.simple import naive_ensemble
    from pickwise.operators.metrics import majority_vote

    if cfg.model == "naive_ensemble":
        return naive_ensemble(rows, verifiers)
    if cfg.model == "first_sample":
        return rows.withColumn("p1", (F.col("sample_idx") == 0).cast("double"))
    if cfg.model == "majority_vote":
        picked = majority_vote(rows, 1, "majority", cfg.answer).select("problem_id", F.col("majority_idx").alias("sample_idx"), F.lit(1.0).alias("__pick"))
        return rows.join(picked, ["problem_id", "sample_idx"], "left").withColumn("p1", F.coalesce("__pick", F.lit(0.0))).drop("__pick")
    raise ValueError(f"unknown model {cfg.model}")


def run_selection(scores: DataFrame, verifiers, model: str = "naive_bayes", train_split: float = 1.0,
                  normalize: str = "minmax_all", threshold: float = 0.5, seed: int = 42, bins: int = 10,
                  answer: str = "answer"):
    """:func:`run` with the most used settings as arguments."""
    return run(scores, verifiers, RunConfig(model=model, train_split=train_split, normalize=normalize, threshold=threshold, seed=seed, bins=bins, answer=answer))
