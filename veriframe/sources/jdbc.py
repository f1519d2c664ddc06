"""Connection options of the supported databases."""

from __future__ import annotations

from collections.abc import Mapping

from veriframe.errors import SourceError

# Fixed values per database: keys that must be set, default port and schema, address, driver class.
PRESETS = {
    "sqlserver": {
        "required": ("server", "database", "username", "password"),
        "port": 1433,
        "schema": "dbo",
        "url": "jdbc:sqlserver://{server}:{port};database={database};"
               "encrypt={encrypt};trustServerCertificate={trust_server_certificate}",
        "defaults": {"encrypt": True, "trust_server_certificate": False},
        "driver": None,
    },
    "teradata": {
        "required": ("host", "database", "username", "password"),
        "port": 1025,
        "schema": None,
        "url": "jdbc:teradata://{host}/DATABASE={database},LOGMECH={logmech}",
        "defaults": {"logmech": "LDAP"},
        "driver": "com.teradata.jdbc.TeraDriver",
    },
    "redshift": {
        "required": ("host", "database", "username", "password"),
        "port": 5439,
        "schema": "public",
        "url": "jdbc:redshift://{host}:{port}/{database}",
        "defaults": {},
        "driver": "com.amazon.redshift.jdbc.Driver",
    },
    "aurora_postgresql": {
        "required": ("host", "database", "username", "password"),
        "port": 5432,
        "schema": "public",
        "url": "jdbc:postgresql://{host}:{port}/{database}?sslmode={sslmode}",
        "defaults": {"sslmode": "require"},
        "driver": "org.postgresql.Driver",
    },
    "mysql": {
        "required": ("host", "database", "username", "password"),
        "port": 3306,
        "schema": None,
        "url": "jdbc:mysql://{host}:{port}/{database}",
        "defaults": {},
        "driver": "com.mysql.cj.jdbc.Driver",
    },
    "oracle": {
        "required": ("host", "database", "username", "password"),
        "port": 1521,
        "schema": None,
        "url": "jdbc:oracle:thin:@//{host}:{port}/{database}",
        "defaults": {},
        "driver": "oracle.jdbc.OracleDriver",
    },
}


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def jdbc_options(kind: str, config: Mapping) -> tuple[dict[str, str], str | None]:
    """(options for Spark's `jdbc` format, schema that unqualified tables belong to)."""
    preset = PRESETS[kind]
    missing = [k for k in preset["required"] if not config.get(k)]
    if missing:
        raise SourceError(f"missing in the {kind} configuration: {', '.join(missing)}")
    values = {"port": preset["port"], **preset["defaults"], **config}
    options = {
        "url": preset["url"].format(**{k: _text(v) for k, v in values.items()}),
        "user": config["username"],
        "password": config["password"],
        "fetchsize": _text(config.get("fetchsize") or 10000),
    }
    if preset["driver"]:
        options["driver"] = preset["driver"]
    schema = config.get("schema") or preset["schema"]
    if kind == "teradata":
        schema = schema or config["database"]
        if config.get("port"):  # its URL has no place for a port but a parameter
            options["url"] += f",DBS_PORT={_text(config['port'])}"
    return options, schema
