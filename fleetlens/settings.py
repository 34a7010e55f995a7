"""What a caller brings: everything about a fleet that is not a rule of the convention."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Names owned by the caller's organisation.

    ``applications`` are (name, code) pairs. Account ids come with the data.
    """

    domain: str = "example.io"
    organisation: str = "example"
    web_host: str = "app.example.io"
    log_service: str = "web-app"
    applications: tuple[tuple[str, str], ...] = field(
        default=(("AppOne", "one"), ("Cdk", "cdk"))
    )
