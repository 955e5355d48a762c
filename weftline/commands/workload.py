"""Paths of a workload within the container that runs it."""

from __future__ import annotations

import os.path

MOUNT = "/work"


def _below(project: str, path: str, what: str) -> str:
    relative = os.path.relpath(path, project).replace("\\", "/")
    if relative.startswith(".."):
        raise ValueError(what)
    return relative


def in_container(project: str, path: str) -> str:
    """A host path as the container has it; ValueError for one outside the project."""
    relative = _below(project, path, f"{path} is outside the mounted project {project}")
    return MOUNT if relative == "." else f"{MOUNT}/{relative}"


def driver_path(project: str, driver: str) -> str:
    """The driver's path within the project; outside it, its imports would not resolve."""
    return _below(project, driver, f"driver {driver} must be inside the mounted project {project}")


def scaffold_files(kind: str) -> list[tuple[str, str]]:
    """(template, file) of the files that a scaffold of this kind has."""
    files = [("Dockerfile", "Dockerfile")]
    for name, kinds in (("cpu_profile_driver", ("cpu-profile", "both")), ("loadtest_driver", ("loadtest", "both"))):
        if kind in kinds:
            files.append((f"{name}.template.ts", f"{name}.ts"))
    return files
