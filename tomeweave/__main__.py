"""python -m tomeweave PATH...: analyse catalogues, print their summaries, optionally write the evidence.

Exit status: 1 if an input failed, 2 if something awaits a decision or could not be measured, else 0.
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tomeweave", description=__doc__)
    p.add_argument("paths", nargs="+", help="folders that hold the items")
    p.add_argument("--sample", type=int, default=16, help="pages measured in each item")
    p.add_argument("--margin", type=float, default=0.05, help="relative difference that counts as equal")
    p.add_argument("--auto", type=float, default=0.85, help="similarity from which items are copies")
    p.add_argument("--review", type=float, default=0.65, help="similarity from which a pair is to be reviewed")
    p.add_argument("--accept-review", action="store_true", help="take pairs to review as copies")
    p.add_argument("--no-retry-overflow", action="store_true", help="no second grouping of overfull folders")
    p.add_argument("--verify-content", action="store_true", help="compare page hashes with the winner's")
    p.add_argument("--delete-losers", action="store_true", help="plan deletions instead of moves")
    p.add_argument("--language", choices=("ja", "en"), default="ja", help="language of folder names")
    p.add_argument("--duplicates-folder", help="folder for losers")
    p.add_argument("--aliases", help="JSON file of series aliases")
    p.add_argument("--backend", default="auto", help="archive backend")
    p.add_argument("--output", help="folder for the laid-out result, one archive for each input; without it nothing but evidence is written")
    p.add_argument("--output-suffix", default="_flat", help="put after the input's name for the result")
    p.add_argument("--wrap-format", choices=("rar", "zip"), default="zip", help="kind of the result; rar needs its program, else zip")
    p.add_argument("--rar-level", type=int, default=3, help="compression of a rar result, 0 to 5")
    p.add_argument("--recovery", type=int, default=5, help="recovery record of a rar result in percent, 0 to 10")
    p.add_argument("--work-dir", help="where the result is laid out before it is packed; by default beside the output")
    p.add_argument("--keep-work-dir", action="store_true", help="leave the laid-out result there")
    p.add_argument("--evidence", help="CSV file for the evidence; with several paths a number is put before its suffix")
    return p


def _write(result, path, output, args, options) -> None:
    """Lay the result of one input out and pack it."""
    import shutil
    import tempfile
    from pathlib import Path

    from tomeweave.sources.sinks import lay_out, wrap

    if not path.is_dir():
        raise ValueError("a result is laid out for folders; unpack a single archive first")
    output.mkdir(parents=True, exist_ok=True)
    work = tempfile.mkdtemp(prefix=f".{path.name}-", dir=args.work_dir or output)
    try:
        done = lay_out(result.flat, result.actions, result.items, str(path), f"{work}/out", options.folders["others"])
        packed, warning = wrap(f"{work}/out", str(output / f"{path.name}{args.output_suffix}"), args.wrap_format, args.rar_level, args.recovery)
    finally:
        if not args.keep_work_dir:
            shutil.rmtree(Path(work), ignore_errors=True)
    print(f"{packed}: {len(done)} entries, {sum(r == 'skipped' for _, _, r in done)} skipped{'; ' + warning if warning else ''}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verify_content:
        print("--verify-content needs page hashes (a column hashes), which reading folders does not give", file=sys.stderr)
        return 1
    from pathlib import Path

    from pyspark.sql import SparkSession

    from tomeweave.plans.engine import analyze
    from tomeweave.plans.options import Options
    from tomeweave.sources.catalogue import load_aliases, read_catalogue
    from tomeweave.sources.sinks import write_evidence_file

    try:
        options = Options(
            sample=args.sample, margin=args.margin, auto=args.auto, review=args.review, accept_review=args.accept_review,
            aliases=load_aliases(Path(args.aliases).read_text(encoding="utf-8")) if args.aliases else {}, retry_overflow=not args.no_retry_overflow,
            verify_content=args.verify_content, delete_losers=args.delete_losers, language=args.language, duplicates_folder=args.duplicates_folder,
            wrap_format=args.wrap_format, rar_level=args.rar_level, recovery_percent=args.recovery,
        ).checked()
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tomeweave").getOrCreate()
    failed = open_ = 0
    for k, path in enumerate(args.paths):
        try:
            result = analyze(read_catalogue(spark, path, args.sample, args.backend), options)
            row = result.summary.first()
            if args.evidence:
                out = Path(args.evidence)
                write_evidence_file(result.evidence, str(out if len(args.paths) == 1 else out.with_name(f"{out.stem}-{k + 1}{out.suffix}")))
            if args.output:
                _write(result, Path(path), Path(args.output), args, options)
        except Exception as e:  # one bad input must not end the others
            print(f"{path}: {e}", file=sys.stderr)
            failed += 1
            continue
        print(f"{path}: " + ", ".join(f"{name[2:]} {row[name]}" for name in row.asDict()))
        open_ += row["n_pending"] + row["n_unmeasured"]
    return 1 if failed else 2 if open_ else 0


if __name__ == "__main__":
    sys.exit(main())
