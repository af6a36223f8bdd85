"""`key=value` settings: '#' and ';' start comments, unknown keys are left out, later lines win."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ..schema import LogError

# Other names of settings.
ALIASES = {"id": "node_id", "dir": "data_dir", "memtable_size": "max_memtable_size", "sync": "sync_wal"}
TRUE, FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


@dataclass(frozen=True)
class Settings:
    node_id: str = "node-1"
    data_dir: str = "./data"
    max_memtable_size: int = 64 << 20
    sync_wal: bool = True
    client_port: int = 50051
    peer_port: int = 50052
    metrics_port: int = 9090

    def validated(self) -> Settings:
        ports = [self.client_port, self.peer_port, self.metrics_port]
        if any(not 0 < p < 65536 for p in ports) or len(set(ports)) < 3:
            raise LogError("ports must be distinct and within 1..65535")
        if not self.node_id or not self.data_dir or self.max_memtable_size < 1:
            raise LogError("node_id, data_dir and max_memtable_size must be set")
        return self


def parse(text: str, base: Settings = Settings()) -> Settings:
    kinds = {f.name: f.type for f in fields(Settings)}
    found: dict[str, object] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#;" or "=" not in line:
            continue
        name, value = (x.strip() for x in line.split("=", 1))
        name = ALIASES.get(name.lower(), name.lower())
        if name not in kinds:
            continue
        if kinds[name] == "bool":
            if value.lower() not in TRUE | FALSE:
                raise LogError(f"{name}: not a truth value: {value}")
            found[name] = value.lower() in TRUE
        elif kinds[name] == "int":
            if not value.isdigit():
                raise LogError(f"{name}: not a number: {value}")
            found[name] = int(value)
        else:
            found[name] = value
    return replace(base, **found)
