"""Settings of a vault; read once on the driver, never a table but for the concepts."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

# Directories that the link graph never enters, beside the folders of the tool in use (``VaultConfig.tool_dirs``).
EXCLUDED_DIRS = [".obsidian", ".git", ".claude", ".alcove", "_template", "seeded", "harness-engineering", "01-Projects", "release"]
# Top-level directories that are no projects, beside the five configured ones.
SYSTEM_DIRS = ["01-Projects", "02-Areas", "03-Resources", "Chats", "Clippings", "temp_conversions", "logs", "target", ".obsidian", ".git", ".alcove", ".claude"]
# Top-level directories that the dashboard leaves out, beside all others that begin with a dot.
DASHBOARD_EXCLUDED = [".git", ".obsidian", ".alcove", ".claude", "target"]
# Type tags by file name and by the name of the parent directory.
TYPE_TAGS = {
    "PRD.md": "type/prd", "ARCHITECTURE.md": "type/architecture", "CONVENTIONS.md": "type/convention", "DECISIONS.md": "type/decision",
    "PROGRESS.md": "type/progress", "DEBT.md": "type/debt", "SECRETS_MAP.md": "type/reference", "CODE_INDEX.md": "type/reference",
}
FOLDER_TYPE_TAGS = {"reports": "type/report", "specs": "type/spec", "plans": "type/plan", "research": "type/research", "strategy": "type/strategy"}
# Tags that a document's stem earns it.
STEM_TAGS = {
    "PRD": ["prd"], "ARCHITECTURE": ["architecture"], "CONVENTIONS": ["conventions"], "DECISIONS": ["decisions", "adr"],
    "PROGRESS": ["progress"], "DEBT": ["tech-debt"], "SECRETS_MAP": ["secrets"],
}


@dataclass
class Concept:
    """A rule: documents holding any keyword are about ``name`` and earn ``tags``."""

    name: str
    keywords: list[str]
    tags: list[str] = field(default_factory=list)


@dataclass
class ModelConfig:
    """Which model answers, and how many questions may be out at a time."""

    provider: str = "ollama"
    model: str = "gemma3"
    base_url: str | None = None
    api_key: str | None = None
    max_concurrent: int | None = None  #: 5, if not given


@dataclass
class VaultConfig:
    name: str = "vault"
    inbox_dir: str = "00-Inbox"
    zettelkasten_dir: str = "10-Zettelkasten"
    archive_dir: str = "99-Archives"
    attachments_dir: str = "Attachments"
    templates_dir: str = "Templates"
    system_dirs: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    excluded_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED_DIRS))
    tool_dirs: list[str] = field(default_factory=list)
    protected_files: list[str] = field(default_factory=lambda: ["index.md"])
    concepts: list[Concept] = field(default_factory=list)
    backlinks: bool = True
    bridge_notes: bool = True
    auto_tags: bool = True
    related_projects: bool = True
    sync_minutes: int | None = None
    daemon_seconds: int | None = None
    model: ModelConfig = field(default_factory=ModelConfig)

    def steps(self) -> list[str]:
        """The steps of a sync round that are switched on, in order."""
        on = {"bridge notes": self.bridge_notes, "backlinks": self.backlinks, "related": self.related_projects, "auto tags": self.auto_tags}
        return ["hubs", "home", "index", *(name for name, x in on.items() if x)]

    def all_system_dirs(self) -> list[str]:
        own = [self.inbox_dir, self.zettelkasten_dir, self.archive_dir, self.attachments_dir, self.templates_dir]
        return list(dict.fromkeys([*own, *SYSTEM_DIRS, *self.system_dirs]))

    def graph_excluded(self) -> list[str]:
        return list(dict.fromkeys([*self.excluded_dirs, *self.tool_dirs]))

    def dashboard_excluded(self) -> list[str]:
        return list(dict.fromkeys([*DASHBOARD_EXCLUDED, *self.tool_dirs, *(d for d in (self.attachments_dir, self.templates_dir) if d), *self.system_dirs]))

    def interval_seconds(self, cli: int | None = None) -> int:
        """Seconds between sync rounds: given, else the daemon's, else sync minutes, else 300."""
        return cli or self.daemon_seconds or (self.sync_minutes and self.sync_minutes * 60) or 300

    @classmethod
    def load(cls, root: str, defaults: dict | None = None, shared: str | None = None) -> VaultConfig:
        """``vault.toml`` under ``root``, over the settings of all vaults in the file ``shared``.

        A shared section holds where the vault's own is as built in (``projects``,
        ``graph``), a shared value where the vault sets none (intervals, ``ai``).
        Values of ``defaults`` hold where what results is unset or as built in.
        """
        path = Path(root) / "vault.toml"
        raw = tomllib.loads(path.read_text()) if path.exists() else {}
        more = tomllib.loads(Path(shared).read_text()) if shared and Path(shared).exists() else {}
        plain = cls()
        out = cls(**{k: v for k, v in raw.get("vault", {}).items() if k in cls.__dataclass_fields__ and k not in SECTIONED})
        for section, read in (("projects", _projects), ("graph", _graph)):
            own = read(raw.get(section, {}))
            for k, v in (own if own != read({}) else read(more.get(section, {}))).items():
                setattr(out, k, v)
        for section, key, name in (("sync", "interval_minutes", "sync_minutes"), ("daemon", "interval_seconds", "daemon_seconds")):
            setattr(out, name, raw.get(section, {}).get(key) or more.get(section, {}).get(key))
        known = ModelConfig.__dataclass_fields__
        own, theirs = (ModelConfig(**{k: v for k, v in x.get("ai", {}).items() if k in known}) for x in (raw, more))
        out.model = ModelConfig(**{k: getattr(theirs, k) if getattr(own, k) == f.default else getattr(own, k) for k, f in known.items()})
        for k, v in (defaults or {}).items():
            if k in cls.__dataclass_fields__ and getattr(out, k) == getattr(plain, k):
                setattr(out, k, v)
        return out


#: Settings of other sections than ``vault``.
SECTIONED = {"exclude", "concepts", "backlinks", "bridge_notes", "auto_tags", "related_projects", "sync_minutes", "daemon_seconds", "model"}


def _projects(section: dict) -> dict:
    return {"exclude": list(section.get("exclude", []))}


def _graph(section: dict) -> dict:
    flags = {k: bool(section.get(k, True)) for k in ("backlinks", "bridge_notes", "auto_tags", "related_projects")}
    return flags | {"concepts": [Concept(c["name"], list(c.get("keywords", [])), list(c.get("tags", []))) for c in section.get("concepts", [])]}


def resolve_vault(flag: str | None = None, env: str = "VAULT_PATH", cwd: str | None = None, registered: list[str] | None = None, levels: int = 6) -> str | None:
    """The vault to work on: the flag, the environment, the nearest folder upwards with ``vault.toml``, or the only one registered."""
    if flag or os.environ.get(env):
        return flag or os.environ[env]
    at = Path(cwd or os.getcwd())
    for folder in [at, *at.parents][:levels]:
        if (folder / "vault.toml").exists():
            return str(folder)
    return registered[0] if registered and len(registered) == 1 else None


def load_prompts(paths: list[str]) -> dict[str, str]:
    """The first readable prompt library (YAML) of ``paths``, over built-in prompts."""
    out = {
        "category_template": "Classify the note as JSON with candidate_type, candidate_project, candidate_area, candidate_concepts, recommended_action, reasoning, subcategory, detail.\n{content}",
        "summary_template": "Summarize the note in one sentence.\n{content}",
        "summarize_template": "Summarize the text in at most {length} characters, key points only.\n{content}",
        "relations_template": "Name the relation of each pair as JSON.\n{content}",
    }
    for p in paths:
        if os.path.exists(p):
            import yaml

            with open(p) as f:
                out |= {k: v for k, v in (yaml.safe_load(f) or {}).items() if isinstance(v, str)}
            break
    return out
