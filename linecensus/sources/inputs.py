"""Other ways to files: path lists, version control, revisions and archives. Commands run on the driver, without a shell where possible."""

from __future__ import annotations

import os
import shlex
import shutil
import subprocess
import tarfile
import tempfile
import zipfile
from pathlib import Path

#: Suffix -> what unpacks it.
ARCHIVES = {".tar": "tar", ".tar.gz": "tar", ".tar.z": "tar", ".tar.xz": "tar", ".tar.bz2": "tar", ".tgz": "tar", ".gem": "tar", ".src.rpm": "rpm2cpio", ".whl": "zip", ".zip": "zip", ".deb": "dpkg-deb"}


def list_file(path: str) -> list[str]:
    """Paths of a list: one a line, trimmed; blank and # lines dropped."""
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8", errors="replace").splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def archive_kind(name: str) -> str | None:
    """What unpacks a file of this name; None: no archive. Longest suffix first, any case."""
    return next((ARCHIVES[s] for s in sorted(ARCHIVES, key=len, reverse=True) if name.lower().endswith(s)), None)


def unpack(path: str, to: str, template: str | None = None) -> None:
    """template: a shell command with >FILE< instead of the built-in way."""
    kind = archive_kind(path)
    os.makedirs(to, exist_ok=True)
    if template:
        subprocess.run(template.replace(">FILE<", shlex.quote(os.path.abspath(path))), shell=True, check=True, cwd=to)
    elif kind == "tar":
        with tarfile.open(path) as t:
            t.extractall(to, filter="data")
    elif kind == "zip":
        with zipfile.ZipFile(path) as z:
            z.extractall(to)
    elif kind == "dpkg-deb":
        subprocess.run(["dpkg-deb", "-x", os.path.abspath(path), "."], check=True, cwd=to)
    elif kind == "rpm2cpio":
        rpm = subprocess.run(["rpm2cpio", os.path.abspath(path)], check=True, capture_output=True).stdout
        subprocess.run(["cpio", "-idm", "--quiet"], input=rpm, check=True, cwd=to)
    else:
        raise ValueError(f"{path}: not an archive")


def numbered(folder: str | None) -> str | None:
    """The next unused numbered folder below `folder`, empty."""
    if not folder:
        return None
    k = next(k for k in range(1, 1 << 30) if not os.path.exists(os.path.join(folder, str(k))) or os.path.join(folder, str(k)) not in _given)
    to = os.path.join(folder, str(k))
    shutil.rmtree(to, ignore_errors=True)
    os.makedirs(to)
    _given.add(to)
    return to


#: Numbered folders of this run: an older run's are cleared and used again.
_given: set[str] = set()


def expanded(paths: list[str], folder: str | None = None, template: str | None = None) -> list[str]:
    """Archives among the paths replaced by folders of their contents; archives within are unpacked too, and removed."""
    out = []
    for p in paths:
        if not os.path.isfile(p) or not (template or archive_kind(p)):
            out.append(p)
            continue
        to = numbered(folder) or tempfile.mkdtemp(prefix="linecensus-")
        unpack(p, to, template)
        while inner := sorted(str(f) for f in Path(to).rglob("*") if f.is_file() and archive_kind(f.name)):
            for f in inner:
                unpack(f, f"{f}.unpacked")
                os.remove(f)
        out.append(to)
    return out


def _out(command: list[str] | str, folder: str) -> list[str]:
    run = subprocess.run(command, shell=isinstance(command, str), cwd=folder, capture_output=True, text=True)
    if run.returncode:
        raise RuntimeError(f"{command}: {run.stderr.strip() or run.returncode}")
    return [x for x in run.stdout.splitlines() if x]


def vcs_command(kind: str, folder: str) -> list[str] | str:
    if kind == "auto":
        kind = next((k for k in ("git", "svn") if os.path.isdir(os.path.join(folder, f".{k}"))), "")
        if not kind:
            raise ValueError(f"{folder}: no version control found")
    return {"git": ["git", "ls-files"], "svn": ["svn", "list", "-R"]}.get(kind, kind)


def vcs_files(kind: str, inputs: list[str], exclude_dirs: tuple[str, ...] = ()) -> list[str]:
    """Files that version control lists, sorted, once; named files narrow the list by prefix. Excluded folders apply here too."""
    folders, narrow = [p for p in inputs if os.path.isdir(p)] or ["."], [p for p in inputs if not os.path.isdir(p)]
    found = {os.path.normpath(os.path.join(d, f)) for d in folders for f in _out(vcs_command(kind, d), d) if not f.endswith("/")}
    found = {f for f in found if not set(f.split(os.sep)[:-1]) & set(exclude_dirs)}
    return sorted(f for f in found if not narrow or any(f.startswith(os.path.normpath(n)) for n in narrow))


def submodules(folder: str) -> list[str]:
    return [x.split()[1] for x in _out(["git", "submodule", "status"], folder) if len(x.split()) > 1]


def is_revision(text: str, folder: str = ".") -> bool:
    """A path that exists is never a revision."""
    return not os.path.exists(text) and subprocess.run(["git", "rev-parse", "--verify", "--quiet", f"{text}^{{commit}}"], cwd=folder, capture_output=True).returncode == 0


def export(revision: str, folder: str = ".", to: str | None = None) -> str:
    to = to or tempfile.mkdtemp(prefix="linecensus-rev-")
    data = subprocess.run(["git", "archive", "--format=tar", revision], cwd=folder, check=True, capture_output=True).stdout
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.seek(0)
        with tarfile.open(fileobj=f) as t:
            t.extractall(to, filter="data")
    return to


def changed_files(old: str, new: str, folder: str = ".") -> list[str]:
    return _out(["git", "diff", "--name-only", old, new], folder)
