"""Errors that the library raises, by cause."""

from __future__ import annotations


class DatawardError(Exception):
    code = "ERROR"


class NotFoundError(DatawardError):
    code = "NOT_FOUND"


class BadRequestError(DatawardError):
    code = "BAD_REQUEST"


class UniqueError(DatawardError):
    code = "UNIQUE"


class ForeignKeyError(DatawardError):
    code = "FOREIGN_KEY"


class NotNullError(DatawardError):
    code = "NOT_NULL"


class CheckError(DatawardError):
    code = "CHECK"


class SoftDeleteError(DatawardError):
    code = "SOFT_DELETE"


class RecordNotDeletedError(SoftDeleteError):
    code = "RECORD_NOT_DELETED"


class AuditError(DatawardError):
    code = "AUDIT"


class AuditRestoreError(AuditError):
    code = "AUDIT_RESTORE"


class AuditMissingValuesError(AuditError):
    code = "AUDIT_MISSING_VALUES"


class TimestampsError(DatawardError):
    code = "TIMESTAMPS"


class TimestampColumnMissingError(TimestampsError):
    code = "TIMESTAMP_COLUMN_MISSING"


class PolicyViolationError(DatawardError):
    code = "POLICY_VIOLATION"


class ContextMissingError(DatawardError):
    code = "CONTEXT_MISSING"


class PolicySchemaError(DatawardError):
    code = "POLICY_SCHEMA"


class PluginError(DatawardError):
    code = "PLUGIN"


class ConflictError(DatawardError):
    """Another writer committed first."""

    code = "CONFLICT"


class TransactionError(DatawardError):
    code = "TRANSACTION"


class MigrationError(DatawardError):
    code = "MIGRATION"
