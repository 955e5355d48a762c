"""One verdict on an edit from a project's own checks."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

#: Runs a command in a folder: (exit code, None for a signal; output).
Runner = Callable[[str, str], tuple[int | None, str]]
TAIL = 80


@dataclass(frozen=True)
class Check:
    name: str
    command: str | None
    status: str = "skipped"  # pass, fail or skipped
    exit_code: int | None = None
    duration_ms: int = 0
    output: str = ""
    skipped_reason: str | None = None


@dataclass(frozen=True)
class Verdict:
    """``ok``: a check ran and none failed; ``behavior_verified``: the tests ran and
    passed; ``degraded``: a check was left out."""

    ok: bool
    behavior_verified: bool
    degraded: bool
    checks: list[Check]
    summary: str

    def as_dict(self) -> dict:
        return asdict(self)


def plan(scripts: Mapping[str, object], typecheck: str = "typecheck", test: str = "test", skip_typecheck: bool = False, skip_tests: bool = False) -> list[Check]:
    """The two checks, each with its command or the reason that it won't run."""

    def one(name: str, script: str, skip: bool) -> Check:
        if skip:
            return Check(name, None, skipped_reason="skipped by request")
        if not isinstance(scripts.get(script), str):
            return Check(name, None, skipped_reason=f'no "{script}" script in package.json')
        return Check(name, f"npm run {script}")

    return [one("typecheck", typecheck, skip_typecheck), one("test", test, skip_tests)]


def summarize(checks: Sequence[Check]) -> Verdict:
    ran = [c for c in checks if c.status != "skipped"]
    failed = [c.name for c in ran if c.status == "fail"]
    test = next((c for c in checks if c.name == "test"), None)
    behaves = test is not None and test.status == "pass"
    if not ran:
        says = "could not verify: neither a type-check nor a test script ran, so the change is unverified"
    elif failed:
        says = f"FAILED: {' and '.join(failed)} did not pass: revert the edit"
    elif behaves:
        says = f"verified: {' + '.join(c.name for c in ran)} passed (behaviour checked)"
    else:
        says = f"type-check passed, but {(test and test.skipped_reason) or 'tests did not run'}: behaviour NOT verified"
    return Verdict(bool(ran) and not failed, behaves, any(c.status == "skipped" for c in checks), list(checks), says)


def scripts_of(folder: str) -> dict[str, str]:
    """The scripts that a package file names; none where it is missing or broken."""
    try:
        found = json.loads(Path(folder, "package.json").read_text(encoding="utf-8"))["scripts"]
        return {k: v for k, v in found.items() if isinstance(v, str)}
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return {}


def _run(command: str, folder: str) -> tuple[int | None, str]:
    try:
        done = subprocess.run(command, shell=True, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, errors="replace", check=False)
    except OSError as why:
        return 1, str(why)
    return (done.returncode if done.returncode >= 0 else None), done.stdout


def verify(folder: str = ".", run: Runner = _run, tail: int = TAIL, **how: object) -> Verdict:
    """Run the checks of the project in ``folder``, one after the other."""
    done = []
    for check in plan(scripts_of(folder), **how):  # type: ignore[arg-type]
        if check.command is None:
            done.append(check)
            continue
        began = time.monotonic()
        code, output = run(check.command, folder)
        lines = output.split("\n")
        kept = "\n".join(lines[-tail:]) if 0 < tail < len(lines) else output
        done.append(Check(check.name, check.command, "pass" if code == 0 else "fail", code, int((time.monotonic() - began) * 1000), kept))
    return summarize(done)
