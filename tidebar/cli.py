"""python -m tidebar.cli {clean,profile,features,train,backtest,infer} ...: thin commands over the library."""

from __future__ import annotations

import argparse

from .config import FeatureConfig, LabelConfig, SplitConfig, profile
from .engine import Models, backtest, infer, session, walk_forward, write_manifest
from .operators.checks import quality_score
from .plans.feature_plan import build
from .sources.bars import numbered, read_csv, resample
from .sources.sinks import write_csv, write_parquet


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidebar", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("clean", "profile", "features", "train", "backtest", "infer"):
        c = commands.add_parser(name)
        c.add_argument("--csv", required=True, nargs="+")
        c.add_argument("--output", required=name != "profile")
        c.add_argument("--symbol", default="default")
        c.add_argument("--every", default=None, help="resample to this step first")
        c.add_argument("--include", default=None)
        c.add_argument("--exclude", default=None)
        c.add_argument("--models", default=None)
        c.add_argument("--profile", default="default")
        c.add_argument("--train-months", type=int, default=6)
        c.add_argument("--validation-months", type=int, default=1)
        c.add_argument("--slide-months", type=int, default=1)
        c.add_argument("--horizon", type=int, default=12)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    bars = read_csv(spark, args.csv, args.symbol)
    bars = numbered(resample(bars, args.every) if args.every else bars)
    features = FeatureConfig(include=args.include, exclude=args.exclude)
    if args.command == "clean":
        write_csv(bars, args.output)
    elif args.command == "profile":
        quality_score(bars).show(truncate=False)
    elif args.command == "features":
        write_parquet(build(bars, features), args.output)
    elif args.command == "train":
        splits, labels = SplitConfig(args.train_months, args.validation_months, args.slide_months), LabelConfig(args.horizon)
        results, best = walk_forward(bars, splits, features, labels)
        best.save(args.output)
        write_csv(results, f"{args.output}/results")
        write_manifest(f"{args.output}/manifest.json", features, labels, splits, best)
    elif args.command == "backtest":
        found = backtest(bars, Models.load(args.models), features, profile(args.profile))
        for part in ("metrics", "breakdown", "costs", "calibration", "trades"):
            write_csv(getattr(found, part), f"{args.output}/{part}")
    else:
        write_csv(infer(bars, Models.load(args.models), features, profile(args.profile)), args.output)


if __name__ == "__main__":
    main()
