"""What to copy or move where, as a table; and doing so."""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.config import Params
from shutterlake.functions import formats
from shutterlake.functions.paths import relative_target, settle_conflicts
from shutterlake.sources.files import local_path


def transfer_plan(assigned: DataFrame, target: str, p: Params = Params(), duplicates: str | None = None, errors: str | None = None, failed: DataFrame | None = None, move: bool = False, existing: DataFrame | None = None, rounds: tuple[int, ...] = (8, 16)) -> DataFrame:
    """src, dst, kind, action; no two files have one dst (with fewer rounds of suffixes, few have).

    Unique files go below the target; duplicates, if there is a folder for them,
    to one named like their best file; representatives below the target (not
    with a folder for duplicates, if skip_representatives is on); files in error
    to theirs. Of files of one target, of any kind, all but the first by path get
    a suffix; the first too if `existing` (dst) has the target already.
    """
    kinds = ["unique"] if duplicates and p.skip_representatives else ["unique", "representative"]
    main = assigned.where(F.col("role").isin(kinds)).withColumn("dst", F.concat(F.lit(target.rstrip("/") + "/"), relative_target(p.path_format, p.seed)))
    plan = main.select(F.col("path").alias("src"), "dst", F.col("role").alias("kind"))
    if duplicates:
        dst = F.concat_ws("/", F.lit(duplicates.rstrip("/")), formats.stem("best_path"), formats.basename("path"))
        plan = plan.unionByName(assigned.where("role = 'duplicate'").select(F.col("path").alias("src"), dst.alias("dst"), F.lit("duplicate").alias("kind")))
    if errors and failed is not None:
        plan = plan.unionByName(failed.select(F.col("path").alias("src"), F.concat_ws("/", F.lit(errors.rstrip("/")), formats.basename("path")).alias("dst"), F.lit("error").alias("kind")))
    return settle_conflicts(plan, "dst", "src", p.seed, existing, rounds).withColumn("action", F.lit("move" if move else "copy"))


def _claim(part: str, dst: str) -> None:
    """Gives a finished file its name, never that of another file."""
    try:
        os.link(part, dst)
        os.unlink(part)
    except FileExistsError:
        raise
    except OSError:  # no hard links here
        if os.path.exists(dst):
            raise FileExistsError(dst) from None
        os.rename(part, dst)


def _put(src: str, dst: str, move: bool) -> None:
    """Copies or moves without overwriting: a target of the same bytes is done, any other is an error and the source stays."""
    src, dst = local_path(src), local_path(dst)
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    if os.path.exists(dst):
        if not os.path.exists(src):  # an earlier attempt moved it
            return
        if os.path.samefile(src, dst):
            return
        if not filecmp.cmp(src, dst, shallow=False):
            raise FileExistsError(f"{dst} holds another file")
        if move:
            os.unlink(src)
        return
    if move:
        try:
            if os.stat(src).st_dev == os.stat(os.path.dirname(dst)).st_dev:
                _claim(src, dst)
                return
        except FileExistsError:
            _put(src, dst, move)  # another attempt was faster
            return
    part = f"{dst}.part-{uuid.uuid4().hex}"
    try:
        shutil.copy2(src, part)
        _claim(part, dst)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    if move:
        os.unlink(src)


def execute(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """plan with error; files move only if dry_run is off. A repeated task finds its work done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors: list[str | None] = []
            for src, dst, action in zip(pdf["src"], pdf["dst"], pdf["action"], strict=True):
                try:
                    if not dry_run:
                        _put(src, dst, action == "move")
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pdf.assign(error=pd.Series(errors, dtype=object))

    return plan.select("src", "dst", "kind", "action").mapInPandas(run, "src string, dst string, kind string, action string, error string")


def clear_folder(folder: str) -> None:
    """Removes the plain files of a report folder, which is made if it is not there; a folder in it is an error."""
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        os.unlink(os.path.join(folder, name))
