"""How ORDER and SHARED of the toxicity model were chosen: python tests/llm/tune_toxicity.py SF_DIR...

Only rows that the query does not hold out are looked at. Of these, ids of one remainder are judged by a model of the others.
"""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def main(folders):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from gleaner.llm import toxicity

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for sf in folders:
        docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
        fold = toxicity.fold_of(F.col("doc_id"), toxicity.FOLDS)
        rows = docs.join(labels, "doc_id").where("toxic is not null").select("text", "toxic", fold.alias("fold")).where("fold > 0").cache()
        for order in (3, 4):
            for shared in range(1, order):
                counts = toxicity.gram_counts(rows.where("fold > 1"), order)
                model = toxicity.Model(*toxicity.kneser_ney(counts, order, shared), order, shared)
                got = toxicity.with_evidence(rows.where("fold = 1"), model).where("evidence is not null").select("evidence", "toxic").toPandas()
                x, y = got["evidence"].to_numpy(), got["toxic"].to_numpy()
                rank = np.argsort(np.argsort(x))
                auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
                print(f"{sf} order {order} shared {shared}: AUC {auc:.4f}, caught at 1 % of the others flagged {(x[y == 1] > np.quantile(x[y == 0], 0.99)).mean():.3f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
