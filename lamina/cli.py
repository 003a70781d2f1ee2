"""Command line over a repository kept in ``.lamina``: ``python -m lamina.cli COMMAND``."""

from __future__ import annotations

import argparse
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamina.kernel.merge import conflict_markers, file_intents, merge_files
from lamina.kernel.textdiff import diff_text
from lamina.operators import listing
from lamina.repo import MergeConflict, Repo, RepoError
from lamina.sources import git_snapshot, html_view, working_tree


def merge_driver(ours: str, base: str, theirs: str, path: str) -> int:
    """Merge three files into ``ours``; 1 and marker lines where they conflict, 2 for binary contents."""
    try:
        texts = [Path(p).read_text() for p in (base, ours, theirs)]
    except UnicodeDecodeError:
        return 2
    merged = merge_files(path, *texts)
    Path(ours).write_text(merged.text if merged.clean else conflict_markers(texts[1], texts[0], texts[2]))
    return 0 if merged.clean else 1


def diff_driver(path: str, old: str, new: str) -> str:
    """What changed in a file: intents where it has structure, lines elsewhere."""
    a, b = Path(old).read_text(), Path(new).read_text()
    said = file_intents(path, a, b)
    if said is None:
        said = [f"{'-' if e.op == 'delete' else '+'}{e.line + 1} {e.content}" for e in diff_text(a, b)]
    return "\n".join([path, *[f"  {line}" for line in said]])


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamina", description=__doc__)
    top.add_argument("-C", dest="root", default=".", help="working tree")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **flags):
        one = sub.add_parser(name)
        for a in arguments:
            one.add_argument(a.rstrip("?*"), nargs=a[-1] if a[-1] in "?*" else None)
        for flag, kind in flags.items():
            one.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    command("init")
    command("commit", message=str, all=bool)
    command("add", "paths*", update=bool, all=bool)
    command("log", "name?", limit=int)
    command("status")
    command("diff", "old?", "new?", html=str, staged=bool, path=str)
    command("branch", "name?", delete=bool)
    command("tag", "name?", delete=bool)
    command("checkout", "name", force=bool)
    command("reset", "name", mode=str, force=bool)
    command("merge", "name", resolve=str)
    command("revert", "name")
    command("cherry-pick", "name")
    command("rebase", "name?", resume=bool, abort=bool, resolve=str, edited=bool)
    command("stash", "action?", message=str, untracked=bool)
    command("bisect", "good", "bad", "script")
    command("bisect-start", "bad", "good")
    command("bisect-mark", "verdict", "name?")
    command("bisect-reset")
    command("blame", "path")
    command("merge-base", "a", "b")
    command("gc", prune=bool, prune_history=bool)
    command("fsck", prune_refs=bool)
    command("repack")
    command("remote", "name?", "path?", delete=bool)
    command("fetch", "name", depth=int)
    command("push", "name", "branch")
    command("clone", "source", depth=int)
    command("config", "name", "email")
    command("import-git", "source")
    command("merge-driver", "ours", "base", "theirs", "path")
    command("diff-driver", "path", "old", "new")
    return top


def _resolutions(text: str | None) -> dict[str, str]:
    """``path:ours`` or ``path:theirs``, by commas; a path may hold colons but not be given twice."""
    out: dict[str, str] = {}
    for item in (text or "").split(",") if text else []:
        path, _, choice = item.rpartition(":")
        if choice not in ("ours", "theirs") or not path or path in out:
            raise RepoError("bad_resolution", f"{item!r} is no resolution")
        out[path] = choice
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    root, store = args.root, str(Path(args.root) / ".lamina")
    if args.command == "init":
        Repo.init(spark, store)
        return "ready"
    if args.command == "clone":
        repo = Repo.clone(spark, args.source, store, args.depth)
        repo.checkout("HEAD", root, force=True)
        return f"{len(repo.branches())} branches"
    repo = Repo.discover(spark, root)
    tree = lambda: working_tree.load(spark, root)
    rows = lambda df: "\n".join("\t".join("" if v is None else str(v) for v in r) for r in df.toLocalIterator())
    match args.command:
        case "commit":
            return repo.commit(args.message or "", tree() if args.all else None)
        case "add":
            some = listing.targets(repo.status(root), args.paths, args.update, args.all).collect()
            taken = spark.createDataFrame([(r["path"],) for r in some if not r["deleted"]], "path string")
            repo.add(tree().join(taken, "path"), [r["path"] for r in some if r["deleted"]])
            return f"{len(some)} paths"
        case "log":
            return rows(repo.log(args.name or "HEAD", args.limit or 20))
        case "status":
            return rows(repo.status(root).orderBy("path"))
        case "diff":
            what = (args.old, args.new or "HEAD") if args.old else "staged" if args.staged else "tree"
            if args.html:
                return f"{html_view.write_views(repo.views(what, root, args.path), args.html)} files"
            if not args.old:
                found = repo.diff_staged(args.path) if args.staged else repo.diff_tree(root, args.path)
                return _told(found)
            new, old = args.new or "HEAD", args.old
            if args.path:
                return _told(repo.diff_states(old, new, args.path))
            return rows(listing.state_diff(repo.manifest(old), repo.manifest(new)).orderBy("seq", "path").drop("seq"))
        case "branch" | "tag":
            branch = args.command == "branch"
            if not args.name:
                return "\n".join(repo.branches() if branch else repo.tags())
            if args.delete:
                (repo.remove_branch if branch else repo.remove_tag)(args.name)
            else:
                (repo.create_branch if branch else repo.tag)(args.name)
            return args.name
        case "checkout":
            return repo.checkout(args.name, root, args.force)
        case "reset":
            repo.reset(args.name, args.mode or "hard", root, args.force)
            return repo.head()
        case "merge":
            was = _written(repo, root)
            state = repo.merge(args.name, resolutions=_resolutions(args.resolve))
            return _follow(repo, root, was, state)
        case "revert" | "cherry-pick":
            was = _written(repo, root)
            getattr(repo, args.command.replace("-", "_"))(args.name)
            return _follow(repo, root, was, repo.head())
        case "rebase":
            was = _written(repo, root, clean=not (args.abort or args.resume))
            if args.abort:
                repo.rebase_abort()
            elif args.resume:
                repo.rebase_continue(_resolutions(args.resolve), tree() if args.edited else None)
            else:
                repo.rebase(args.name)
            return _follow(repo, root, was, repo.head())
        case "stash":
            if args.action in ("apply", "pop"):
                entries = repo.stash_apply(drop=args.action == "pop")
                return f"{working_tree.materialize(repo.files(entries), root)} files"
            if args.action in ("drop", "clear"):
                repo.stash_drop(0 if args.action == "drop" else None)
            elif args.action != "list":
                repo.stash(tree(), args.message or "", args.untracked)
                repo.reset("HEAD", "hard", root, force=True)
            return "\n".join(f"{i}\t{m}" for i, _, m in repo.stashes())
        case "bisect":

            def test(state: str) -> int:
                repo.checkout(state, root, force=True)
                return subprocess.run(args.script, shell=True, cwd=root).returncode

            _written(repo, root)
            was = _branch(repo) or repo.head()
            try:
                return repo.bisect(args.good, args.bad, test) or "only skipped states are left"
            finally:
                repo.checkout(was, root, force=True)
        case "bisect-start" | "bisect-mark":
            _written(repo, root)
            after = (repo.bisect_start(args.bad, args.good), repo.bisect_next())[1] if args.command == "bisect-start" else repo.bisect_mark(args.verdict, args.name or "HEAD")
            if after is None:
                return "\n".join(repo.bisect_found())
            return repo.checkout(after, root, force=True)
        case "bisect-reset":
            return repo.bisect_reset(root)
        case "blame":
            return "\n".join(f"{owner[:8]} {line + 1} {text}" for line, owner, text in repo.blame(args.path))
        case "merge-base":
            return repo.merge_base(args.a, args.b)
        case "gc":
            return "\n".join(f"{k}\t{n}\t{b}" for k, n, b in repo.gc(args.prune, args.prune_history))
        case "fsck":
            return "\n".join(repo.prune_refs()) if args.prune_refs else "\n".join(f"{k}\t{d}" for k, d in repo.fsck())
        case "repack":
            return f"{repo.repack()} blobs"
        case "remote":
            if not args.name:
                return "\n".join(f"{k}\t{v}" for k, v in repo.remotes().items())
            if args.delete:
                repo.remove_remote(args.name)
            else:
                repo.add_remote(args.name, args.path)
            return args.name
        case "fetch":
            return f"{repo.fetch(args.name, args.depth)} states"
        case "push":
            return f"{repo.push(args.name, args.branch)} states"
        case "config":
            repo.set_identity(args.name, args.email)
            return args.name
        case "import-git":
            files = git_snapshot.read_git(spark, args.source).where(~F.col("path").startswith(".lamina/"))
            return repo.commit(f"import of {Path(args.source).name}", files)
    raise RepoError("unknown", args.command)


def _branch(repo: Repo) -> str | None:
    return repo.refs()["head"].get("branch")


def _written(repo: Repo, root: str, clean: bool = True) -> list[str]:
    """Paths of HEAD's files, once it is sure that the tree has nothing else (unless not ``clean``)."""
    repo._guard(root, not clean)
    return [r["path"] for r in repo.manifest("HEAD").select("path").collect()]


def _follow(repo: Repo, root: str, was: list[str], state: str) -> str:
    """Write HEAD's files after a verb that moved it; files of before that it lacks are deleted."""
    working_tree.materialize(repo.files(repo.manifest("HEAD")), root, was)
    return state


def _told(changes) -> str:
    """Described changes as text, by path."""
    out = []
    for r in changes.orderBy("path").toLocalIterator():
        start = f"{r['from_path']} -> " if r["from_path"] else ""
        out += [f"{r['change']} {start}{r['path']}", *[f"  {line}" for line in r["lines"]]]
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "merge-driver":
        return merge_driver(args.ours, args.base, args.theirs, args.path)
    if args.command == "diff-driver":
        print(diff_driver(args.path, args.old, args.new))
        return 0
    try:
        print(run(args, spark or SparkSession.builder.appName("lamina").getOrCreate()))
    except MergeConflict as error:
        print("\n".join(f"conflict in {p}: {why}" for p, why in error.conflicts), file=sys.stderr)
        return 1
    except RepoError as error:
        print(f"{error.kind}: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
