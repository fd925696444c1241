"""Sources of ``files(path, text)``: trees, single files, git scopes, standard input and tables.

Names are found on the driver, those of a large tree on the executors, and tested
as column expressions; only then are files read, on the executors: what a script
has no rule for is never opened.
"""

from __future__ import annotations

import os
import pickle
import subprocess
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, SourceError
from .globs import Ignore, takes

#: Bytes of text to a record batch.
BATCH_BYTES = 8 << 20

FILES = "root_idx int, path string, text string"


@dataclass(frozen=True)
class WalkOptions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    respect_ignore: bool = True
    follow_symlinks: bool = False
    jobs: int | None = None


def _git_root(path: str) -> str | None:
    while True:
        if os.path.exists(os.path.join(path, ".git")):
            return path
        parent = os.path.dirname(path)
        if parent == path:
            return None
        path = parent


class Folder(NamedTuple):
    """A folder that is to be listed: its absolute path, its name as shown, its path below the root, and what holds there."""

    root: int
    path: str
    shown: str
    rel: str
    ignore: Ignore
    seen: frozenset[str]  # folders above it, where links are followed


def _top(i: int, root: str, options: WalkOptions) -> Folder:
    top = os.path.abspath(root)
    ignore = Ignore()
    if options.respect_ignore:
        git = _git_root(top)
        if git:
            ignore = ignore.file(git, os.path.expanduser("~/.config/git/ignore")).file(git, os.path.join(git, ".git", "info", "exclude"))
            chain, at = [], top
            while at != git:
                at = os.path.dirname(at)
                chain.append(at)
            for folder in reversed(chain):
                ignore = ignore.plus(folder, ".gitignore").plus(folder, ".ignore")
    return Folder(i, top, root, "", ignore, frozenset({os.path.realpath(top)}))


def _listed(f: Folder, options: WalkOptions) -> Iterator[str | Folder]:
    """What a folder holds that the options leave, by name: files as shown, and folders. Ignored ones are not entered."""
    ignore = f.ignore
    if options.respect_ignore:
        ignore = ignore.plus(f.path, ".gitignore").plus(f.path, ".ignore")
    try:
        entries = sorted(os.scandir(f.path), key=lambda e: e.name)
    except OSError as e:
        raise SourceError(f"{f.path}: {e}") from e
    for e in entries:
        at = f"{f.rel}/{e.name}" if f.rel else e.name
        is_dir = e.is_dir(follow_symlinks=options.follow_symlinks)
        if options.respect_ignore and (e.name.startswith(".") or ignore.has(e.path, is_dir)):
            continue
        if is_dir:
            real = os.path.realpath(e.path)
            if real not in f.seen:
                yield Folder(f.root, e.path, os.path.join(f.shown, e.name), at, ignore, f.seen | {real})
        elif e.is_file(follow_symlinks=options.follow_symlinks) and takes(at, options.include, options.exclude):
            yield os.path.join(f.shown, e.name)


def _below(f: Folder, options: WalkOptions) -> Iterator[str]:
    for x in _listed(f, options):
        if isinstance(x, Folder):
            yield from _below(x, options)
        else:
            yield x


def discover(root: str, options: WalkOptions) -> Iterator[str]:
    """Regular files below ``root`` that the options leave, folder by folder in the order of names."""
    yield from _below(_top(0, root, options), options)


#: Folders that the driver finds before the executors list what is below them.
SPREAD = 256


def _names(spark: SparkSession, files: list[tuple[int, str]], folders: list[Folder], options: WalkOptions) -> DataFrame:
    """(root_idx, path) of the files and of all files below the folders. A large tree is listed by the executors, but for its uppermost levels."""
    open_, rows = deque(folders), list(files)
    while open_ and len(open_) < SPREAD:
        f = open_.popleft()
        for x in _listed(f, options):
            if isinstance(x, Folder):
                open_.append(x)
            else:
                rows.append((f.root, x))
    out = spark.createDataFrame(rows, "root_idx int, path string")
    if not open_:
        return out

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                f = pickle.loads(raw.as_py())
                names = _below(f, options)
                while some := list(islice(names, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([f.root] * len(some), pa.int32()), pa.array(some)], names=["root_idx", "path"])

    rest = spark.createDataFrame([(pickle.dumps(f),) for f in open_], "folder binary").repartition(len(open_))
    return out.unionByName(rest.mapInArrow(run, "root_idx int, path string"))


def read_paths(spark: SparkSession, paths: DataFrame, on_error: str = "raise", jobs: int | None = None) -> DataFrame:
    """``paths(root_idx, path)`` with each file's text, read by the executors.

    Files must be UTF-8. ``on_error`` = ``skip`` leaves out what can't be read;
    otherwise the run fails.
    """

    base = os.getcwd()  # workers keep the folder that they were started in

    def run(batches):
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string())], names=["root_idx", "path", "text"])

        for batch in batches:
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(os.path.join(base, p), "rb") as f:
                        raw = f.read()
                    rows.append((i, p, raw.decode("utf-8")))
                except (OSError, UnicodeDecodeError) as e:
                    if on_error == "skip":
                        continue
                    raise SourceError(f"{p}: {e}") from e
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    # by a hash, as neighbours in a tree are of like size
    spread = paths.repartition(jobs or spark.sparkContext.defaultParallelism, F.xxhash64("path"))
    return spread.mapInArrow(run, FILES)


def tree(spark: SparkSession, roots: str | list[str], options: WalkOptions | None = None, relevant: Column | None = None, on_error: str = "raise") -> DataFrame:
    """The files of trees and single files, root by root as given; ``relevant`` tests the column ``path`` before anything is read.

    A single file skips ignore rules. A missing root raises :class:`ConfigError`;
    no files give an empty table.
    """
    options = options or WalkOptions()
    rows: list[tuple[int, str]] = []
    folders: list[Folder] = []
    for i, root in enumerate([roots] if isinstance(roots, str) else roots):
        if os.path.isfile(root):
            if takes(os.path.basename(root), options.include, options.exclude) or takes(root.lstrip("./"), options.include, options.exclude):
                rows.append((i, root))
        elif os.path.isdir(root):
            folders.append(_top(i, root, options))
        else:
            raise ConfigError(f"no such path: {root}")
    paths = _names(spark, rows, folders, options)
    if relevant is not None:
        paths = paths.filter(relevant)
    return read_paths(spark, paths, on_error, options.jobs)


def _git(args: list[str], folder: str) -> str:
    try:
        got = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=False)
    except OSError as e:
        raise ConfigError(f"git: {e}") from e
    if got.returncode:
        raise ConfigError(f"git {' '.join(args)}: {got.stderr.strip()}")
    return got.stdout


def git_paths(folder: str, since: str | None = None, staged: bool = False) -> list[str]:
    """Paths that git says were added, copied, modified, renamed or changed in type, if they are there still."""
    scope = [since] if since is not None else ["--cached"] if staged else []
    top = _git(["rev-parse", "--show-toplevel"], folder).strip()
    names = _git(["diff", "--name-only", "-z", "--diff-filter=ACMRT", *scope], folder).split("\0")
    return [p for p in (os.path.join(top, n) for n in names if n) if os.path.isfile(p)]


def git_changed(spark: SparkSession, folder: str, since: str | None = None, staged: bool = False, relevant: Column | None = None) -> DataFrame:
    """The files of a git scope. Globs and ignore rules don't apply to them."""
    paths = spark.createDataFrame([(0, p) for p in git_paths(folder, since, staged)], "root_idx int, path string")
    return read_paths(spark, paths.filter(relevant) if relevant is not None else paths)


def select(spark: SparkSession, roots: list[str], options: WalkOptions | None = None, since: str | None = None, staged: bool = False, base: str = ".", relevant: Column | None = None) -> DataFrame:
    """Changed since a commit, else staged, else the trees."""
    if since is not None or staged:
        return git_changed(spark, base, since, staged and since is None, relevant)
    return tree(spark, roots, options, relevant)


def given(spark: SparkSession, path: str, text: str) -> DataFrame:
    """One file that isn't on disk; the path says what kind it is."""
    return spark.createDataFrame([(0, path, text)], FILES)


def packs(base: str = ".", home: str | None = None) -> list[tuple[str, str, str]]:
    """(name, path, source) of scripts in the nearest repository's and the home folder's ``.quillmill/packs``."""
    out = []
    repo = _git_root(os.path.abspath(base))
    for source, top in (("repo", repo), ("user", home or os.path.expanduser("~"))):
        folder = top and os.path.join(top, ".quillmill", "packs")
        if folder and os.path.isdir(folder):
            found = sorted(e.path for e in os.scandir(folder) if e.is_file() and e.name.endswith(".codemod"))
            out += [(os.path.basename(p).removesuffix(".codemod"), p, source) for p in found]
    return out
