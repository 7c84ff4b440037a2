"""Settings for an S3-compatible object store."""

from __future__ import annotations


def s3a_settings(
    endpoint: str,
    access_key: str,
    secret_key: str,
    path_style: bool = True,
    ssl: bool = False,
    connections: int = 100,
) -> dict[str, str]:
    prefix = "spark.hadoop.fs.s3a."
    return {
        prefix + "endpoint": endpoint,
        prefix + "access.key": access_key,
        prefix + "secret.key": secret_key,
        prefix + "path.style.access": str(path_style).lower(),
        prefix + "connection.ssl.enabled": str(ssl).lower(),
        prefix + "connection.maximum": str(connections),
        prefix + "fast.upload": "true",
        prefix + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def dated_path(bucket: str, zone: str, name: str, day: str) -> str:
    """Address of one day of a table kept as dated files."""
    return f"s3a://{bucket}/{zone}/{name}_{day}.parquet"
