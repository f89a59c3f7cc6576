"""How files come into place as a whole, whichever process is lost meanwhile.

A job has a folder `_temporary/<id>` below its target, made by the driver. Each attempt of a task makes one folder below
it, never the job's, so nothing comes back once the driver has deleted that, however late a task is. When all
tasks have succeeded the driver writes a journal: from then on the job counts as done, and its files are renamed into place. A
rename that is repeated changes nothing, so whoever finds a journal can go on: `recover` finishes jobs that have one, and
undoes those without, if it is told that nobody works on them any more.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs

TEMPORARY, JOURNAL = "_temporary", "journal.json"
#: Renames at once.
THREADS = 16


class JobGone(RuntimeError):
    """The job has ended; what this task would write isn't wanted any more."""


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; one without a scheme is local."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(folder)
    return pafs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def sync_folder(fs: pafs.FileSystem, folder: str) -> None:
    """Puts a rename in a local folder on disk; other stores do so themselves."""
    if isinstance(fs, pafs.LocalFileSystem):
        at = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(at)
        finally:
            os.close(at)


def there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def begin(folder: str) -> str:
    """A new job's folder; the only place that makes folders above its own."""
    fs, at = open_folder(folder)
    name = f"{TEMPORARY}/{uuid.uuid4().hex}"
    for left in range(4, -1, -1):
        try:
            fs.create_dir(f"{at}/{name}", recursive=True)
            break
        except OSError:  # a job that ends may take the folder above with it
            if not left:
                raise
    return f"{folder.rstrip('/')}/{name}"


def attempt_folder(job: str, name: str) -> str:
    """A folder of one attempt below the job's, which must be there."""
    fs, at = open_folder(job)
    if not there(fs, at):
        raise JobGone(job)
    try:
        fs.create_dir(f"{at}/{name}", recursive=False)
    except OSError as e:
        if there(fs, at):
            raise
        raise JobGone(job) from e
    return f"{job}/{name}"


def discard(folder: str, tries: int = 50) -> None:
    """Deletes a folder until it is gone; tasks that still run may be writing into it."""
    fs, at = open_folder(folder)
    top = at.rpartition("/")[0]
    if isinstance(fs, pafs.LocalFileSystem):  # by another name nobody finds it, and writes no more
        try:
            gone = f"{at}.{uuid.uuid4().hex}.gone"
            os.rename(at, gone)
            at = gone
        except OSError:
            pass
    for k in range(tries):
        try:
            if not there(fs, at):
                break
            fs.delete_dir(at)
        except OSError:
            time.sleep(min(0.01 * (k + 1), 0.2))
    if top.endswith("/" + TEMPORARY) and isinstance(fs, pafs.LocalFileSystem):
        try:
            os.rmdir(top)  # only if no other job is below
        except OSError:
            pass


def write_once(fs: pafs.FileSystem, path: str, content: dict) -> None:
    """A small file that is there as a whole or not at all."""
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(json.dumps(content).encode())
    fs.move(temp, path)
    sync_folder(fs, path.rpartition("/")[0])


def read_json(fs: pafs.FileSystem, path: str) -> dict | None:
    if not there(fs, path):
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def publish(fs: pafs.FileSystem, staged: str, path: str) -> None:
    """Renames a finished file into place. One that a lost attempt has renamed before is left as it is."""
    is_there, is_here = there(fs, path), there(fs, staged)
    if is_here and is_there:
        raise FileExistsError(path)
    if is_here:
        try:
            fs.move(staged, path)
        except OSError:  # another attempt of the same task may have been faster
            if not there(fs, path):
                raise
    elif not is_there:
        raise FileNotFoundError(staged)


def move_all(fs: pafs.FileSystem, moves: Iterable[tuple[str, str]]) -> None:
    """Renames files into place, several at once."""
    moves = list(moves)
    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(lambda m: publish(fs, *m), moves))
    for folder in sorted({to.rpartition("/")[0] for _, to in moves}):
        sync_folder(fs, folder)


def record(job: str, journal: dict) -> None:
    """From here on the job is done, and what is left of it will be finished by someone."""
    fs, at = open_folder(job)
    write_once(fs, f"{at}/{JOURNAL}", journal)


def finish_moves(job: str) -> bool:
    """Finishes a job whose journal lists its renames; says whether it has one."""
    fs, at = open_folder(job)
    journal = read_json(fs, f"{at}/{JOURNAL}")
    if not journal or "moves" not in journal:
        return False
    move_all(fs, [tuple(m) for m in journal["moves"]])
    discard(job)
    return True


def jobs(folder: str) -> list[tuple[str, dict | None]]:
    """Jobs below a target that haven't ended, with their journals."""
    fs, at = open_folder(folder)
    if not there(fs, f"{at}/{TEMPORARY}"):
        return []
    found = fs.get_file_info(pafs.FileSelector(f"{at}/{TEMPORARY}"))
    return [(f"{folder.rstrip('/')}/{TEMPORARY}/{f.base_name}", read_json(fs, f"{f.path}/{JOURNAL}")) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.Directory]
