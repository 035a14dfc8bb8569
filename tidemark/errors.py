"""Errors of tables, logs, sessions."""

from __future__ import annotations


class TidemarkError(Exception):
    """Base of all errors."""


class StorageError(TidemarkError):
    """A file is missing, unreadable or misplaced."""


class LogCorruptError(StorageError):
    """The commit log can't be replayed."""


class UnsupportedFormatError(LogCorruptError):
    """The log has a format version or a table kind that this engine doesn't read."""


class AlreadyExistsError(StorageError):
    """A table is there already."""


class EmptyTableError(TidemarkError):
    """The log holds no commit yet."""


class ConflictError(TidemarkError):
    """Another writer has committed the expected version."""

    def __init__(self, expected: int, found: int) -> None:
        super().__init__(f"expected version {expected}, the table is at {found}")
        self.expected, self.found = expected, found


class AmbiguousCommitError(TidemarkError):
    """The commit file may exist although publishing it failed; nothing was cleaned up."""


class SchemaMismatchError(TidemarkError):
    """An append's schema differs from the table's beyond lossless widening."""


class EmptySourceError(SchemaMismatchError):
    """An append's source holds no batch or no row."""


class IndexColumnError(SchemaMismatchError):
    """The index or an entity column is missing or of an unfit type."""


class SegmentError(SchemaMismatchError):
    """Rows can't make a segment: no index value at all, an entity without one, or a null entity."""


class CoverageError(StorageError):
    """Coverage of the table is missing or unreadable."""


class MissingCoverageError(CoverageError):
    """A live segment names no coverage."""


class OptimizeError(TidemarkError):
    """A table can't be rewritten, or a rewrite failed its checks."""


class RollbackError(TidemarkError):
    """An operation failed, and so did removing what it had written; original is the first cause."""

    def __init__(self, original: BaseException, failures: list[OSError]) -> None:
        super().__init__(f"{original}; {len(failures)} file(s) could not be removed: {failures[0]}")
        self.original, self.failures = original, failures


class CoverageOverlapError(TidemarkError):
    """An append covers buckets that are already covered."""

    def __init__(self, overlap_count: int, bucket_id: int, bucket_start, bucket_end, entity: tuple | None, segment_path: str) -> None:
        who = "" if entity is None else f" for entity {entity!r}"
        super().__init__(f"{overlap_count} covered bucket(s) overlap{who}; the first is {bucket_id} [{bucket_start}, {bucket_end})")
        self.overlap_count, self.bucket_id, self.bucket_start, self.bucket_end = overlap_count, bucket_id, bucket_start, bucket_end
        self.entity, self.segment_path = entity, segment_path


class EntityError(TidemarkError):
    """An entity identity doesn't fit the table's entity columns."""


class EntityNotConfiguredError(EntityError):
    """An identity was given for a table without entity columns."""


class MissingEntityError(EntityError):
    """An entity column has no component in the identity."""


class UnexpectedEntityError(EntityError):
    """A component names no entity column."""


class DuplicateEntityError(EntityError):
    """A component is given twice."""


class EntityTypeError(EntityError):
    """A component's value is not of its column's type."""


class RangeError(TidemarkError, ValueError):
    """A range's start is not before its end, or a bound is of the wrong domain."""


class SqlError(TidemarkError):
    """A SQL query failed to plan or run."""
