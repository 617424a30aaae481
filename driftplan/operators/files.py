"""What executors do to files, on this machine or through an agent: the same four actions."""

from __future__ import annotations

import base64
import json
import os
import re
import shutil
import subprocess
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from ..sources.wire import SPEC_TYPES


class Files(Protocol):
    """The write side of a destination. Paths are absolute; what fails raises OSError.

    ``anywhere``, if there is such an attribute and it is true: tasks can use it, and find the same files.
    """

    def touch(self, path: str, mtime: int) -> None: ...

    def mkdir(self, path: str) -> None: ...

    def move(self, old: str, new: str) -> None: ...

    def copy(self, old: str, new: str, mtime: int, reflink: bool = False) -> None: ...


class LocalFiles:
    """Files that this machine sees. Nothing is overwritten by a move, and a copy appears whole or not at all."""

    anywhere = True

    def touch(self, path: str, mtime: int) -> None:
        os.utime(path, (mtime, mtime))

    def mkdir(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def move(self, old: str, new: str) -> None:
        if os.path.lexists(new):
            raise FileExistsError(f"something is at {new!r} already")
        os.rename(old, new)

    def copy(self, old: str, new: str, mtime: int, reflink: bool = False) -> None:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        part = f"{new}.tmp"
        try:
            if not (reflink and _cloned(old, part)):
                shutil.copyfile(old, part)
                shutil.copymode(old, part)
            os.utime(part, (mtime, mtime))
            os.replace(part, new)
        except OSError:
            if os.path.exists(part):
                os.remove(part)
            raise


def _cloned(source: str, target: str) -> bool:
    """A copy that shares blocks where the file system can, by the system's copy command; False where there is no such command."""
    try:
        return subprocess.run(["cp", "--reflink=auto", "-p", source, target], capture_output=True).returncode == 0
    except FileNotFoundError:
        return False


class AgentFiles:
    """Files of an agent. ``exchange`` sends request lines and gives the lines that answer them.

    ``anywhere``: it can be sent to tasks, each of which then has an agent of its own for the same files.
    """

    def __init__(self, exchange: Callable[[list[str]], Iterable[str]], anywhere: bool = False):
        self.exchange, self.anywhere = exchange, anywhere

    def touch(self, path: str, mtime: int) -> None:
        base, name = os.path.split(path)
        self._perform({"type": SPEC_TYPES["touch"], "dest_base_path": base, "dest_rel_path": name, "mod_timestamp": mtime})

    def mkdir(self, path: str) -> None:
        self._perform({"type": SPEC_TYPES["mkdir"], "dir_path": path})

    def move(self, old: str, new: str) -> None:
        base = os.path.commonpath([os.path.dirname(old), os.path.dirname(new)])
        self._perform({"type": SPEC_TYPES["move"], "base_path": base, "from_rel_path": os.path.relpath(old, base), "to_rel_path": os.path.relpath(new, base)})

    def copy(self, old: str, new: str, mtime: int, reflink: bool = False) -> None:
        self._perform({"type": SPEC_TYPES["copy"], "from_abs_path": old, "to_abs_path": new, "mod_timestamp": mtime} | ({"use_reflink": True} if reflink else {}))

    def _perform(self, spec: dict) -> None:
        for kind, payload in map(opened, self.exchange([line("perform_request", {"actions": [spec], "dry_run": False})])):
            if kind == "error":
                raise OSError(payload.get("message"))
            if kind == "perform_response":
                result = payload["results"][0]
                if not result["success"]:
                    raise OSError(result.get("error") or "the agent gives no reason")
                return
        raise OSError("the agent doesn't answer")


class Command:
    """An ``exchange`` with an agent that a command starts, say over ssh: requests go to its input, answers come from its output."""

    #: Messages that end the answer to a request.
    LAST = ("walk_response", "digest_response", "perform_response", "error")

    def __init__(self, command: list[str]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")

    def __call__(self, requests: list[str]) -> Iterator[str]:
        for request in requests:
            try:
                self.process.stdin.write(request + "\n")
                self.process.stdin.flush()
            except BrokenPipeError as e:
                raise OSError(f"the agent ended with code {self.process.wait()}") from e
            for answer in self.process.stdout:
                yield answer
                if opened(answer)[0] in self.LAST:
                    break

    def __enter__(self) -> Command:
        return self

    def __exit__(self, *_) -> None:
        try:
            if self.process.poll() is None:
                self.process.stdin.write(line("quit") + "\n")
            self.process.stdin.close()
        except BrokenPipeError:  # it ended by itself
            pass
        self.process.wait()
        self.process.stdout.close()


def line(kind: str, payload: dict | None = None) -> str:
    """A message as a line; one without payload has none."""
    body = {} if payload is None else {"payload": base64.b64encode(json.dumps(payload).encode()).decode()}
    return json.dumps({"type": kind} | body)


def opened(text: str) -> tuple[str, dict]:
    message = json.loads(text)
    payload = re.sub(r"[\r\n]", "", message.get("payload") or "")  # some encoders break lines
    return message["type"], json.loads(base64.b64decode(payload, validate=True) or "{}")
