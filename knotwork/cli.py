"""Command line: one entry a stage of the linkage plan, each reading and writing tables of the work folder.

    python -m knotwork.cli all --data-dir data --work-dir work --out-dir out

Stages, in order: prepare, block, refold, features (with prune), second, rank, decide; `all` runs them in one session. `postprocess` rewrites
a link file by rules, `report` prints quality on fold 0, `validate` checks a link file against the candidates, `subset` writes a
share of the data for trials.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.operators import decide, evaluate, rules
from knotwork.plans import linkage, postprocess
from knotwork.plans.workspace import Workspace
from knotwork.session import session
from knotwork.sources import sinks, tables


class Job:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.work = Workspace(spark, args.work_dir)

    def prepare(self) -> None:
        s1, q = tables.load_split(self.spark, self.args.data_dir, self.args.split)
        truth = self.work.save("truth", tables.read_truth(self.spark, f"{self.args.data_dir}/{self.args.split}_ground_truth.tsv", s1, q))
        a, b = linkage.prepare(s1, q, truth)
        self.work.save("entities", a)
        self.work.save("prepared", b)

    def block(self) -> None:
        self.work.save("candidates", linkage.block(self.work.load("entities"), self.work.load("prepared"), self.args.k, self.args.r))

    def refold(self) -> None:
        self.work.save("queries", linkage.refolded(self.work.load("prepared"), self.work.load("candidates"), self.work.load("entities")))

    def features(self) -> None:
        linkage.prune(self.work, self.work.load("candidates"), self.work.load("entities"), self.work.load("queries"), self.args.keep, self.args.least, self.args.rounds)

    def second(self) -> None:
        self.work.save("ranked_input", linkage.second(self.work, self.work.load("pruned"), self.work.load("entities"), self.work.load("queries"), self.args.least_words))

    def rank(self) -> None:
        linkage.rank(self.work, self.work.load("ranked_input"), self.args.rounds)

    def decide(self) -> None:
        scored, s1 = self.work.load("scored"), self.work.load("entities")
        rule = {"mode": "threshold", "t": self.args.threshold} if self.args.threshold is not None else linkage.choose(scored, self.work.load("truth"), s1)
        links = self.work.save("links", linkage.apply_rule(scored, rule))
        self._lists(links, "matching_results", "matched_entity_ids")
        self._lists(self.work.load("pruned"), "candidate_pairs", "candidate_entity_ids")
        print(json.dumps(rule))

    def _lists(self, pairs: DataFrame, name: str, column: str) -> None:
        s1 = self.work.load("entities").select(F.col("idx").alias("s1_idx"), F.col("entity_id").alias("sid"))
        q = self.work.load("queries").select(F.col("idx").alias("q_idx"), F.col("entity_id").alias("qid"))
        lists = sinks.link_lists(pairs.join(s1, "s1_idx").join(q, "q_idx"), s1)
        sinks.write_tsv(lists.select(F.col("sid").alias("source1_entity_id"), F.col("ids").alias(column)), f"{self.args.out_dir}/{name}")

    def postprocess(self) -> None:
        postprocess.rewrite(self.spark, f"{self.args.out_dir}/matching_results", f"{self.args.out_dir}/matching_results_final", self.work.load("entities"), self.work.load("queries"), self.work.load("scored"), self.args.rules.split(","))

    def validate(self) -> None:
        read = lambda name, column: tables.explode_links(tables.read_tsv(self.spark, f"{self.args.out_dir}/{name}", schema.LINKS if column[0] == "m" else schema.CANDIDATE_FILE), "source1_entity_id", column, "qid")
        outside = sinks.outside(read("matching_results", "matched_entity_ids"), read("candidate_pairs", "candidate_entity_ids"), ["source1_entity_id", "qid"]).count()
        print(json.dumps({"links_that_are_no_candidates": outside}))

    def report(self) -> None:
        s1, links = self.work.load("entities"), self.work.load("links")
        held = s1.filter("fold = 0").select(F.col("idx").alias("s1_idx"))
        out = decide.macro_f05(links.select("q_idx", "s1_idx", "p"), self.work.load("truth"), held).first().asDict()
        recall = {r["k"]: r["recall"] for r in evaluate.recall_at(self.work.load("truth"), self.work.load("candidates")).collect()}
        print(json.dumps({"fold_0": out, "blocking_recall": recall}))

    def subset(self) -> None:
        s1, q = tables.load_split(self.spark, self.args.data_dir, self.args.split)
        truth = tables.read_truth(self.spark, f"{self.args.data_dir}/{self.args.split}_ground_truth.tsv", s1, q)
        a, b, t = rules.dev_subset(s1.withColumnRenamed("idx", "s1_idx"), q.withColumnRenamed("idx", "q_idx"), truth, self.args.share)
        raw = [f.name for f in schema.RAW.fields]
        sinks.write_tsv(a.select(*raw), f"{self.args.out_dir}/{self.args.split}_source1.tsv")
        for n in (2, 3):
            sinks.write_tsv(b.filter(F.col("src") == n).select(*raw), f"{self.args.out_dir}/{self.args.split}_source{n}.tsv")
        pairs = t.join(a.select("s1_idx", F.col("entity_id").alias("sid")), "s1_idx").join(b.select("q_idx", F.col("entity_id").alias("qid")), "q_idx")
        lists = sinks.link_lists(pairs, a.select(F.col("entity_id").alias("sid")))
        sinks.write_tsv(lists.select(F.col("sid").alias("source1_entity_id"), F.col("ids").alias("matched_entity_ids")), f"{self.args.out_dir}/{self.args.split}_ground_truth.tsv")


CHAIN = ("prepare", "block", "refold", "features", "second", "rank", "decide")
STAGES = (*CHAIN, "postprocess", "validate", "report", "subset")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="knotwork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--data-dir", default="data")
    p.add_argument("--work-dir", default="work")
    p.add_argument("--out-dir", default="out")
    p.add_argument("--split", default="train")
    p.add_argument("--k", type=int, default=10, help="candidates of a query")
    p.add_argument("--r", type=int, default=10, help="candidates of an entity")
    p.add_argument("--keep", type=int, default=4)
    p.add_argument("--least", type=float, default=0.003)
    p.add_argument("--rounds", type=int, default=30)
    p.add_argument("--least-words", type=int, default=20)
    p.add_argument("--threshold", type=float)
    p.add_argument("--rules", default=",".join(postprocess.RULES))
    p.add_argument("--share", type=float, default=0.01)
    args = p.parse_args(argv)
    job = Job(spark or session("knotwork"), args)
    for stage in CHAIN if args.stage == "all" else [args.stage]:
        run: Callable[[], None] = getattr(job, stage)
        run()


if __name__ == "__main__":
    main()
