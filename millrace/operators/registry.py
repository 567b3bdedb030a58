"""Stored and registered models: tables by name, versions, states, actions."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.commit_log import CommitLog

ENTRY = "project string, name string, version int, path string, action string"


class Registry:
    """A folder with stored tables, fitted models, project states and registered versions.

    Everything lies in a folder that all executors reach. What happens is
    appended to one log, never rewritten, and every stored table or model has
    a folder of its own, so a registered version keeps its content when the
    name is stored again. Any number of writers may work on one registry: two
    registrations at once get two versions, and an action acts on the state
    that the log has when it is added.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    # stored tables and models

    def store_table(self, df: DataFrame, name: str) -> str:
        """Store a table under a name and return its path; ``table`` reads the latest one."""
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._stored("table", name, path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.stored_path(name, "table"))

    def store_model(self, model: PipelineModel, name: str) -> str:
        """Store a fitted model under a name and return its path; ``model`` loads the latest one."""
        path = f"{self.root}/models/{name}/{uuid.uuid4().hex}"
        model.write().save(path)
        return self._stored("model", name, path)

    def model(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.stored_path(name, "model"))

    def _stored(self, kind: str, name: str, path: str) -> str:
        self.log.append(lambda _: {"what": "stored", "kind": kind, "name": name, "path": path})
        return path

    def stored_path(self, name: str, kind: str | None = None) -> str | None:
        """Path of what was stored last under a name; None when there is nothing."""
        return _stored_path(self.log.entries(), name, kind)

    # versions

    def versions(self) -> list[dict]:
        """All registered versions, in the order of their registration."""
        return [e for e in self.log.entries() if e["what"] == "version"]

    def entries(self) -> DataFrame:
        rows = [(e["project"], e["name"], e["version"], e["path"], e["action"]) for e in self.versions()]
        return self.spark.createDataFrame(rows, ENTRY)

    def register(self, path: str | None, name: str, project: str, force: bool = False, action: str = "register") -> int:
        """Add a version. A name that is taken needs ``force``, which adds the next one."""
        return self.log.append(lambda entries: _next_version(entries, path, name, project, force, action))["version"]

    def version_path(self, project: str, name: str, version: int | None = None, action: str | None = None) -> str:
        """Path of a version, or of the newest one; ``action`` asks for one that was, say, published."""
        return self._version(project, name, version, action)["path"]

    def _version(self, project: str, name: str, version: int | None = None, action: str | None = None) -> dict:
        same = [e for e in _same(self.log.entries(), project, name) if version in (None, e["version"]) and action in (None, e["action"])]
        if not same:
            raise ValueError(f"no {action or 'registered'} version {'' if version is None else version} of {project}/{name}")
        return max(same, key=lambda e: e["version"])

    def published_version(self, project: str, name: str) -> int:
        """The newest published version."""
        return self._version(project, name, None, "publish")["version"]

    def published_table(self, project: str, name: str, version: int | None = None) -> DataFrame:
        """The table (such as coefficients) of a published version."""
        return self.spark.read.parquet(self.version_path(project, name, version, "publish"))

    def published_model(self, project: str, name: str, version: int | None = None) -> PipelineModel:
        """The fitted model of a published version."""
        return PipelineModel.load(self.version_path(project, name, version, "publish"))

    # project states and actions on the champion

    def set_state(self, project: str, state: str) -> None:
        """Add a state; the latest one decides."""
        self.log.append(lambda _: {"what": "state", "project": project, "state": state})

    def manage(self, project: str, action: str) -> DataFrame:
        """Register or publish the champion of a completed project.

        Returns one row (project, action, version, message, error); what is
        wrong is told in the row, as a service would. State and version are
        those of one moment: if anything is logged in between, both are read anew.
        """
        said: dict[str, str | None] = {}

        def act(entries: list[dict]) -> dict | None:
            states = [e["state"].lower() for e in entries if e["what"] == "state" and e["project"] == project]
            said.update(message=None, error=None)
            if not states:
                said["error"] = f"no project {project}"
            elif states[-1] != "completed":
                said["message"] = f"project is not completed: {states[-1]}"
            elif action not in ("register", "publish"):
                said["error"] = "invalid action; register or publish"
            else:
                said["message"] = f"{action.capitalize()} done"
                return _next_version(entries, _stored_path(entries, project), project, project, True, action)
            return None

        entry = self.log.append(act)
        schema = "project string, action string, version int, message string, error string"
        row = (project, action, entry["version"] if entry else None, said["message"], said["error"])
        return self.spark.createDataFrame([row], schema)


def _same(entries: list[dict], project: str, name: str) -> list[dict]:
    return [e for e in entries if e["what"] == "version" and (e["project"], e["name"]) == (project, name)]


def _stored_path(entries: list[dict], name: str, kind: str | None = None) -> str | None:
    paths = [e["path"] for e in entries if e["what"] == "stored" and e["name"] == name and kind in (None, e["kind"])]
    return paths[-1] if paths else None


def _next_version(entries: list[dict], path: str | None, name: str, project: str, force: bool, action: str) -> dict:
    taken = [e["version"] for e in _same(entries, project, name)]
    if taken and not force:
        raise ValueError(f"{project}/{name} is registered; use force=True for a new version")
    return {"what": "version", "project": project, "name": name, "version": max(taken, default=0) + 1, "path": path, "action": action}
