"""INFORMATION_SCHEMA, sys views and catalogue procedures over the registered tables."""

from __future__ import annotations

import os
import platform
from datetime import datetime

from pyspark.sql import DataFrame

from ..errors import TsqlError
from ..functions.context import COLLATION, SERVER, object_id
from ..functions.kinds import Kind

#: Precision, scale, length in bytes, ODBC type and system type number of the types that columns have.
TYPES = {
    "int": (10, 0, 4, 4, 56), "bigint": (19, 0, 8, -5, 127), "smallint": (5, 0, 2, 5, 52), "tinyint": (3, 0, 1, -6, 48), "float": (53, None, 8, 6, 62), "nvarchar": (None, None, -1, -9, 231),
    "bit": (None, None, 1, -7, 104), "datetime": (23, 3, 8, 93, 61), "varbinary": (None, None, -1, -3, 165), "uniqueidentifier": (None, None, 16, -11, 36),
}
_MADE = datetime(2024, 1, 1)
_S, _I, _D, _B = "string", "int", "timestamp_ntz", "boolean"


def _fields(text: str, kind: str = _S) -> list[tuple[str, str]]:
    """'A B:int C' as columns, text where nothing is said."""
    return [(n.partition(":")[0], n.partition(":")[2] or kind) for n in text.split()]


#: The INFORMATION_SCHEMA views that have no rows here, with their columns.
EMPTY_VIEWS = {
    "check_constraints": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME CHECK_CLAUSE",
    "column_domain_usage": "DOMAIN_CATALOG DOMAIN_SCHEMA DOMAIN_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME",
    "column_privileges": "GRANTOR GRANTEE TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME PRIVILEGE_TYPE IS_GRANTABLE",
    "constraint_column_usage": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME",
    "constraint_table_usage": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME",
    "domains": "DOMAIN_CATALOG DOMAIN_SCHEMA DOMAIN_NAME DATA_TYPE CHARACTER_MAXIMUM_LENGTH:int CHARACTER_OCTET_LENGTH:int COLLATION_CATALOG COLLATION_SCHEMA COLLATION_NAME CHARACTER_SET_CATALOG CHARACTER_SET_SCHEMA CHARACTER_SET_NAME NUMERIC_PRECISION:int NUMERIC_PRECISION_RADIX:int NUMERIC_SCALE:int DATETIME_PRECISION:int DOMAIN_DEFAULT",
    "domain_constraints": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME DOMAIN_CATALOG DOMAIN_SCHEMA DOMAIN_NAME IS_DEFERRABLE INITIALLY_DEFERRED",
    "key_column_usage": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION:int",
    "parameters": "SPECIFIC_CATALOG SPECIFIC_SCHEMA SPECIFIC_NAME ORDINAL_POSITION:int PARAMETER_MODE IS_RESULT AS_LOCATOR PARAMETER_NAME DATA_TYPE CHARACTER_MAXIMUM_LENGTH:int NUMERIC_PRECISION:int NUMERIC_SCALE:int",
    "referential_constraints": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME UNIQUE_CONSTRAINT_CATALOG UNIQUE_CONSTRAINT_SCHEMA UNIQUE_CONSTRAINT_NAME MATCH_OPTION UPDATE_RULE DELETE_RULE",
    "routines": "SPECIFIC_CATALOG SPECIFIC_SCHEMA SPECIFIC_NAME ROUTINE_CATALOG ROUTINE_SCHEMA ROUTINE_NAME ROUTINE_TYPE DATA_TYPE ROUTINE_BODY ROUTINE_DEFINITION CREATED:timestamp_ntz LAST_ALTERED:timestamp_ntz",
    "routine_columns": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION:int COLUMN_DEFAULT IS_NULLABLE DATA_TYPE",
    "sequences": "SEQUENCE_CATALOG SEQUENCE_SCHEMA SEQUENCE_NAME DATA_TYPE NUMERIC_PRECISION:int NUMERIC_SCALE:int START_VALUE MINIMUM_VALUE MAXIMUM_VALUE INCREMENT",
    "table_constraints": "CONSTRAINT_CATALOG CONSTRAINT_SCHEMA CONSTRAINT_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME CONSTRAINT_TYPE IS_DEFERRABLE INITIALLY_DEFERRED",
    "table_privileges": "GRANTOR GRANTEE TABLE_CATALOG TABLE_SCHEMA TABLE_NAME PRIVILEGE_TYPE IS_GRANTABLE", "views": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME VIEW_DEFINITION CHECK_OPTION IS_UPDATABLE",
    "view_column_usage": "VIEW_CATALOG VIEW_SCHEMA VIEW_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME", "view_table_usage": "VIEW_CATALOG VIEW_SCHEMA VIEW_NAME TABLE_CATALOG TABLE_SCHEMA TABLE_NAME",
}
#: The sys views that have no rows here, with their columns.
EMPTY_SYS = {
    "availability_groups": "group_id name resource_id", "availability_replicas": "replica_id group_id replica_server_name", "computed_columns": "object_id:int name column_id:int definition",
    "default_constraints": "name object_id:int schema_id:int parent_object_id:int parent_column_id:int definition", "dm_hadr_database_replica_states": "database_id:int group_id replica_id is_local:boolean synchronization_state:int",
    "foreign_key_columns": "constraint_object_id:int constraint_column_id:int parent_object_id:int parent_column_id:int referenced_object_id:int referenced_column_id:int",
    "foreign_keys": "name object_id:int schema_id:int parent_object_id:int referenced_object_id:int key_index_id:int is_disabled:boolean delete_referential_action:int update_referential_action:int",
    "identity_columns": "object_id:int name column_id:int seed_value increment_value last_value", "index_columns": "object_id:int index_id:int index_column_id:int column_id:int key_ordinal:int is_descending_key:boolean is_included_column:boolean",
    "master_files": "database_id:int file_id:int type:int type_desc name physical_name state:int size:int", "sql_modules": "object_id:int definition uses_ansi_nulls:boolean", "synonyms": "name object_id:int schema_id:int base_object_name",
    "system_sql_modules": "object_id:int definition", "table_types": "name system_type_id:int user_type_id:int schema_id:int type_table_object_id:int", "xml_indexes": "object_id:int name index_id:int", "xml_schema_collections": "xml_collection_id:int schema_id:int name",
    "views": "name object_id:int schema_id:int type create_date:timestamp_ntz modify_date:timestamp_ntz", "all_views": "name object_id:int schema_id:int type create_date:timestamp_ntz modify_date:timestamp_ntz",
    "extended_properties": "class:int class_desc major_id:int minor_id:int name value", "filetables": "object_id:int is_enabled:boolean directory_name", "dm_hadr_cluster": "cluster_name quorum_type:int quorum_state:int",
    "key_constraints": "name object_id:int schema_id:int parent_object_id:int type unique_index_id:int", "check_constraints": "name object_id:int schema_id:int parent_object_id:int definition", "triggers": "name object_id:int parent_id:int type",
    "procedures": "name object_id:int schema_id:int type", "parameters": "object_id:int name parameter_id:int system_type_id:int", "partitions": "partition_id:int object_id:int index_id:int rows:bigint",
    "syspolicy_configuration": "name current_value", "syspolicy_system_health_state": "health_state_id:int policy_id:int target_query_expression",
}


#: The columns of sys.databases in their order, and what an online, read-only database has in those that are not 0, false or null.
DATABASE_COLUMNS = (
    "name database_id:int source_database_id:int owner_sid:binary create_date:timestamp_ntz compatibility_level:int collation_name user_access:int user_access_desc is_read_only:boolean is_auto_close_on:boolean "
    "is_auto_shrink_on:boolean state:int state_desc is_in_standby:boolean is_cleanly_shutdown:boolean is_supplemental_logging_enabled:boolean snapshot_isolation_state:int snapshot_isolation_state_desc "
    "is_read_committed_snapshot_on:boolean recovery_model:int recovery_model_desc page_verify_option:int page_verify_option_desc is_auto_create_stats_on:boolean is_auto_create_stats_incremental_on:boolean "
    "is_auto_update_stats_on:boolean is_auto_update_stats_async_on:boolean is_ansi_null_default_on:boolean is_ansi_nulls_on:boolean is_ansi_padding_on:boolean is_ansi_warnings_on:boolean is_arithabort_on:boolean "
    "is_concat_null_yields_null_on:boolean is_numeric_roundabort_on:boolean is_quoted_identifier_on:boolean is_recursive_triggers_on:boolean is_cursor_close_on_commit_on:boolean is_local_cursor_default:boolean "
    "is_fulltext_enabled:boolean is_trustworthy_on:boolean is_db_chaining_on:boolean is_parameterization_forced:boolean is_master_key_encrypted_by_server:boolean is_query_store_on:boolean is_published:boolean "
    "is_subscribed:boolean is_merge_published:boolean is_distributor:boolean is_sync_with_backup:boolean service_broker_guid is_broker_enabled:boolean log_reuse_wait:int log_reuse_wait_desc "
    "is_date_correlation_on:boolean is_cdc_enabled:boolean is_encrypted:boolean is_honor_broker_priority_on:boolean replica_id group_database_id resource_pool_id:int default_language_lcid:int default_language_name "
    "default_fulltext_language_lcid:int default_fulltext_language_name is_nested_triggers_on:boolean is_transform_noise_words_on:boolean two_digit_year_cutoff:int containment:int containment_desc "
    "target_recovery_time_in_seconds:int delayed_durability:int delayed_durability_desc is_memory_optimized_elevate_to_snapshot_on:boolean is_federation_member:boolean is_remote_data_archive_enabled:boolean "
    "is_mixed_page_allocation_on:boolean is_temporal_history_retention_enabled:boolean catalog_collation_type:int catalog_collation_type_desc physical_database_name is_result_set_caching_on:boolean "
    "is_accelerated_database_recovery_on:boolean is_tempdb_spill_to_remote_store:boolean is_stale_page_detection_on:boolean is_memory_optimized_enabled:boolean is_data_retention_enabled:boolean is_ledger_on:boolean "
    "is_change_feed_enabled:boolean"
)
DATABASE_VALUES = {
    "name": "master", "physical_database_name": "master", "database_id": 1, "owner_sid": b"", "create_date": _MADE, "compatibility_level": 160, "collation_name": COLLATION, "user_access_desc": "MULTI_USER", "is_read_only": True,
    "state_desc": "ONLINE", "snapshot_isolation_state_desc": "OFF", "recovery_model": 3, "recovery_model_desc": "SIMPLE", "page_verify_option": 2, "page_verify_option_desc": "CHECKSUM", "is_auto_create_stats_on": True,
    "is_auto_update_stats_on": True, "service_broker_guid": "00000000-0000-0000-0000-000000000000", "log_reuse_wait_desc": "NOTHING", "containment_desc": "NONE", "delayed_durability_desc": "DISABLED", "is_mixed_page_allocation_on": True,
    "is_temporal_history_retention_enabled": True, "catalog_collation_type_desc": "DATABASE_DEFAULT", "is_memory_optimized_enabled": True,
    **dict.fromkeys(("source_database_id", "resource_pool_id", "default_language_lcid", "default_fulltext_language_lcid", "is_nested_triggers_on", "is_transform_noise_words_on", "two_digit_year_cutoff")),
}
#: The properties of xp_msver in their order, with what the server has; others are blank.
MSVER = "ProductName ProductVersion Language Platform Comments CompanyName FileDescription FileVersion InternalName LegalCopyright LegalTrademarks OriginalFilename PrivateBuild SpecialBuild WindowsVersion ProcessorCount ProcessorActiveMask ProcessorType PhysicalMemory".split() + ["Product ID"]


def _msver() -> list[tuple]:
    cpus, own = os.cpu_count() or 1, "quillon"
    said = {
        "ProductName": (None, "Microsoft SQL Server"), "ProductVersion": (None, SERVER["PRODUCTVERSION"]), "FileVersion": (None, SERVER["PRODUCTVERSION"]), "Language": (1033, "English (United States)"), "Platform": (None, f"NT {platform.machine()}"),
        "FileDescription": (None, f"{own} on {platform.system()}"), "WindowsVersion": (None, platform.version()), "ProcessorCount": (cpus, str(cpus)), "ProcessorType": (None, platform.machine()), "Product ID": (None, platform.python_version()),
        **dict.fromkeys(("Comments", "CompanyName", "InternalName", "OriginalFilename"), (None, own)),
    }
    return [(i, n, *said.get(n, (None, ""))) for i, n in enumerate(MSVER, 1)]


def _df(engine, fields: list[tuple[str, str]], rows: list[tuple] = ()) -> DataFrame:
    return engine.spark.createDataFrame(list(rows), ", ".join(f"`{n}` {k}" for n, k in fields))


def _columns(engine) -> list[tuple]:
    """(table, column, place, kind) of every column."""
    return [(shown, c.name, i, c.kind) for shown, _, columns in engine.tables.values() for i, c in enumerate(columns, 1)]


def view(engine, schema: str, name: str) -> DataFrame | None:
    """The rows of a view of the catalogue, or None if there is none of that name."""
    tables = [shown for shown, _, _ in engine.tables.values()]
    base = "master", "dbo"
    if schema == "information_schema":
        if name == "tables":
            return _df(engine, _fields("TABLE_CATALOG TABLE_SCHEMA TABLE_NAME TABLE_TYPE"), [(*base, t, "BASE TABLE") for t in tables])
        if name == "columns":
            fields = "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION:int COLUMN_DEFAULT IS_NULLABLE DATA_TYPE CHARACTER_MAXIMUM_LENGTH:int CHARACTER_OCTET_LENGTH:int NUMERIC_PRECISION:int NUMERIC_PRECISION_RADIX:int NUMERIC_SCALE:int DATETIME_PRECISION:int CHARACTER_SET_NAME COLLATION_NAME"
            return _df(engine, _fields(fields), [_described(base, *c) for c in _columns(engine)])
        if name == "schemata":
            return _df(engine, _fields("CATALOG_NAME SCHEMA_NAME SCHEMA_OWNER DEFAULT_CHARACTER_SET_NAME"), [("master", s, s, "iso_1") for s in ("dbo", "INFORMATION_SCHEMA", "sys")])
        return _df(engine, _fields(EMPTY_VIEWS[name])) if name in EMPTY_VIEWS else None
    if name in ("tables", "objects", "all_objects"):
        fields = "name object_id:int principal_id:int schema_id:int parent_object_id:int type type_desc create_date:timestamp_ntz modify_date:timestamp_ntz is_ms_shipped:boolean"
        return _df(engine, _fields(fields), [(t, object_id(t), None, 1, 0, "U ", "USER_TABLE", _MADE, _MADE, False) for t in tables])
    if name in ("columns", "all_columns"):
        fields = "object_id:int name column_id:int system_type_id:int user_type_id:int max_length:int precision:int scale:int collation_name is_nullable:boolean is_identity:boolean is_computed:boolean"
        rows = [(object_id(t), c, i, TYPES[k.shown][4], TYPES[k.shown][4], TYPES[k.shown][2], TYPES[k.shown][0] or 0, TYPES[k.shown][1] or 0, COLLATION if k.text else None, True, False, False) for t, c, i, k in _columns(engine)]
        return _df(engine, _fields(fields), rows)
    fixed = {
        "schemas": ("name schema_id:int principal_id:int", [("dbo", 1, 1), ("INFORMATION_SCHEMA", 3, 3), ("sys", 4, 4)]),
        "types": ("name system_type_id:int user_type_id:int schema_id:int max_length:int precision:int scale:int is_user_defined:boolean", [(n, t[4], t[4], 4, t[2], t[0] or 0, t[1] or 0, False) for n, t in TYPES.items()]),
        "databases": (DATABASE_COLUMNS, [tuple(DATABASE_VALUES[n] if n in DATABASE_VALUES else {"boolean": False, "int": 0}.get(k) for n, k in _fields(DATABASE_COLUMNS))]),
        "indexes": ("object_id:int name index_id:int type:int type_desc is_unique:boolean is_primary_key:boolean", [(object_id(t), None, 0, 0, "HEAP", False, False) for t in tables]),
        "data_spaces": ("name data_space_id:int type type_desc is_default:boolean", [("PRIMARY", 1, "FG", "ROWS_FILEGROUP", True)]), "database_files": ("file_id:int type:int type_desc name state:int size:int", [(1, 0, "ROWS", "master", 0, 0)]),
        "server_principals": ("name principal_id:int type type_desc is_disabled:boolean", [("sa", 1, "S", "SQL_LOGIN", False)]), "database_principals": ("name principal_id:int type type_desc default_schema_name", [("dbo", 1, "S", "SQL_USER", "dbo")]),
        "configurations": ("configuration_id:int name value:int minimum:int maximum:int value_in_use:int description", [(1544, "max server memory (MB)", 2147483647, 128, 2147483647, 2147483647, "Maximum size of server memory (MB)")]),
        "dm_os_host_info": ("host_platform host_distribution host_release host_service_pack_level host_sku:int os_language_version:int host_architecture", [(platform.system(), f"{platform.system()} {platform.release()}", platform.version(), "", None, None, platform.machine())]),
        "database_mirroring": (
            "database_id:int mirroring_guid mirroring_state:int mirroring_state_desc mirroring_role:int mirroring_role_desc mirroring_role_sequence:int mirroring_safety_level:int mirroring_safety_level_desc mirroring_safety_sequence:int "
            "mirroring_partner_name mirroring_partner_instance mirroring_witness_name mirroring_witness_state:int mirroring_witness_state_desc mirroring_failover_lsn:double mirroring_connection_timeout:int mirroring_redo_queue:int "
            "mirroring_redo_queue_type mirroring_end_of_log_lsn:double mirroring_replication_lsn:double", [(1, *(None,) * 20)]),
        "dm_exec_connections": ("session_id:int net_transport auth_scheme encrypt_option", [(51, "TCP", "SQL", "FALSE")]),
        "sysobjects": ("name id:int xtype uid:int crdate:timestamp_ntz", [(t, object_id(t), "U ", 1, _MADE) for t in tables]), "sysusers": ("uid:int name", [(1, "dbo")]),
    }
    if name in fixed:
        return _df(engine, _fields(fixed[name][0]), fixed[name][1])
    return _df(engine, _fields(EMPTY_SYS[name])) if name in EMPTY_SYS else None


def _described(base: tuple, table: str, column: str, place: int, kind: Kind) -> tuple:
    precision, scale, _, _, _ = TYPES[kind.shown]
    text = kind.text
    return (
        *base, table, column, place, None, "YES", kind.shown, -1 if text else None, -1 if text else None, precision if kind.number else None, (2 if kind.name == "float" else 10) if kind.number else None, scale if kind.number else None,
        scale if kind.name == "datetime" else None, "UNICODE" if text else None, COLLATION if text else None,
    )


_TABLES = "TABLE_QUALIFIER TABLE_OWNER TABLE_NAME TABLE_TYPE REMARKS"
_COLUMNS = "TABLE_QUALIFIER TABLE_OWNER TABLE_NAME COLUMN_NAME DATA_TYPE:int TYPE_NAME PRECISION:int LENGTH:int SCALE:int RADIX:int NULLABLE:int REMARKS COLUMN_DEF SQL_DATA_TYPE:int SQL_DATETIME_SUB:int CHAR_OCTET_LENGTH:int ORDINAL_POSITION:int IS_NULLABLE SS_DATA_TYPE:int"
_TABLES_ROWSET = "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME TABLE_TYPE TABLE_GUID DESCRIPTION TABLE_PROPID:int DATE_CREATED:timestamp_ntz DATE_MODIFIED:timestamp_ntz"
_COLUMNS_ROWSET = "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME ORDINAL_POSITION:int IS_NULLABLE:boolean DATA_TYPE:int CHARACTER_MAXIMUM_LENGTH:int NUMERIC_PRECISION:int NUMERIC_SCALE:int DATETIME_PRECISION:int COLLATION_NAME"
#: The rowset procedures without rows here, by the stem of their name.
_EMPTY_ROWSETS = {
    "indexes": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME INDEX_CATALOG INDEX_SCHEMA INDEX_NAME PRIMARY_KEY:boolean UNIQUE:boolean CLUSTERED:boolean TYPE:int ORDINAL_POSITION:int COLUMN_NAME COLLATION:int CARDINALITY:bigint PAGES:int",
    "primary_keys": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME COLUMN_GUID COLUMN_PROPID:int ORDINAL:int PK_NAME",
    "foreign_keys": "PK_TABLE_CATALOG PK_TABLE_SCHEMA PK_TABLE_NAME PK_COLUMN_NAME FK_TABLE_CATALOG FK_TABLE_SCHEMA FK_TABLE_NAME FK_COLUMN_NAME ORDINAL:int UPDATE_RULE DELETE_RULE PK_NAME FK_NAME DEFERRABILITY:int",
    "views": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME VIEW_DEFINITION CHECK_OPTION:boolean IS_UPDATABLE:boolean DESCRIPTION", "column_privileges": "GRANTOR GRANTEE TABLE_CATALOG TABLE_SCHEMA TABLE_NAME COLUMN_NAME PRIVILEGE_TYPE IS_GRANTABLE:boolean",
    "table_privileges": "GRANTOR GRANTEE TABLE_CATALOG TABLE_SCHEMA TABLE_NAME PRIVILEGE_TYPE IS_GRANTABLE:boolean", "procedures": "PROCEDURE_CATALOG PROCEDURE_SCHEMA PROCEDURE_NAME PROCEDURE_TYPE:int PROCEDURE_DEFINITION DESCRIPTION",
    "procedure_params": "PROCEDURE_CATALOG PROCEDURE_SCHEMA PROCEDURE_NAME PARAMETER_NAME ORDINAL_POSITION:int PARAMETER_TYPE:int DATA_TYPE:int TYPE_NAME", "statistics": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME CARDINALITY:bigint",
    "table_statistics": "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME STATISTICS_CATALOG STATISTICS_SCHEMA STATISTICS_NAME STATISTICS_TYPE:int COLUMN_NAME ORDINAL_POSITION:int",
}
#: The names under which each rowset is asked for.
ROWSETS = {
    **dict.fromkeys("sp_tables_rowset sp_tables_rowset2 sp_tables_rowset_rmt sp_tables_info_rowset sp_tables_info_rowset2 sp_tables_info_rowset_64 sp_tables_info_rowset2_64 sp_tables_info_90_rowset sp_tables_info_90_rowset2 sp_tables_info_90_rowset_64 sp_tables_info_90_rowset2_64".split(), "tables"),
    **dict.fromkeys("sp_columns_rowset sp_columns_rowset2 sp_columns_rowset_rmt sp_columns_90_rowset sp_columns_90_rowset2 sp_columns_100_rowset sp_columns_100_rowset2".split(), "columns"),
    **dict.fromkeys("sp_indexes_rowset sp_indexes_rowset2 sp_indexes_90_rowset sp_indexes_90_rowset2 sp_indexes_100_rowset sp_indexes_100_rowset2".split(), "indexes"),
    **dict.fromkeys(("sp_primary_keys_rowset", "sp_primary_keys_rowset2"), "primary_keys"), "sp_schemata_rowset": "schemata", **dict.fromkeys(("sp_catalogs_rowset", "sp_catalogs_rowset2"), "catalogs"),
    **dict.fromkeys(("sp_views_rowset", "sp_views_rowset2"), "views"), **dict.fromkeys(("sp_column_privileges_rowset", "sp_column_privileges_rowset2"), "column_privileges"),
    **dict.fromkeys(("sp_statistics_rowset", "sp_statistics_rowset2"), "statistics"), **dict.fromkeys(("sp_table_statistics_rowset", "sp_table_statistics2_rowset"), "table_statistics"),
    **dict.fromkeys(("sp_procedures_rowset", "sp_procedures_rowset2"), "procedures"), **dict.fromkeys(("sp_foreign_keys_rowset", "sp_foreign_keys_rowset2", "sp_foreign_keys_rowset3"), "foreign_keys"),
    **dict.fromkeys("sp_procedure_params_rowset sp_procedure_params_rowset2 sp_procedure_params_90_rowset sp_procedure_params_90_rowset2 sp_procedure_params_100_rowset sp_procedure_params_100_rowset2".split(), "procedure_params"),
    **dict.fromkeys(("sp_provider_types_rowset", "sp_provider_types_90_rowset", "sp_provider_types_100_rowset"), "types"), **dict.fromkeys(("sp_table_privileges_rowset", "sp_table_privileges_rowset2"), "table_privileges"),
}


def _like(pattern: str | None, value: str) -> bool:
    import re

    if not pattern:
        return True
    return re.fullmatch(re.escape(str(pattern)).replace("%", ".*").replace("_", "."), value, re.I | re.S) is not None


def procedure(engine, session, called: str, args: list[tuple]) -> DataFrame | None:
    """The rows of a catalogue procedure, or None if there is none of that name."""
    named = {n.lower().lstrip("@"): v for n, v in args if n}
    first = [v for n, v in args if n is None]
    table = named.get("table_name") or (first[0] if first else None)
    tables = [t for t, _, _ in engine.tables.values() if _like(table, t)]
    columns = [c for c in _columns(engine) if _like(table, c[0]) and _like(named.get("column_name"), c[1])]
    if called == "xp_msver":
        return _df(engine, _fields("Index:int Name Internal_Value:int Character_Value"), [r for r in _msver() if table is None or r[1].lower() == str(table).lower()])
    if called == "sp_databases":
        return _df(engine, _fields("DATABASE_NAME DATABASE_SIZE:int REMARKS"), [("master", 0, None)])
    if called == "sp_tables":
        return _df(engine, _fields(_TABLES), [("master", "dbo", t, "TABLE", None) for t in tables])
    if called in ("sp_columns", "sp_columns_90", "sp_columns_100", "sp_columns_managed"):
        rows = []
        for t, c, i, k in columns:
            precision, scale, length, odbc, system = TYPES[k.shown]
            rows.append(("master", "dbo", t, c, odbc, k.shown, precision or 0, length, scale, 10 if k.number else None, 1, None, None, odbc, None, length if k.text else None, i, "YES", system))
        return _df(engine, _fields(_COLUMNS), rows)
    what = ROWSETS.get(called)
    if what == "tables":
        return _df(engine, _fields(_TABLES_ROWSET), [("master", "dbo", t, "TABLE", None, None, None, _MADE, _MADE) for t in tables])
    if what == "columns":
        return _df(engine, _fields(_COLUMNS_ROWSET), [("master", "dbo", t, c, i, True, TYPES[k.shown][3], -1 if k.text else None, TYPES[k.shown][0] if k.number else None, TYPES[k.shown][1] if k.number else None, TYPES[k.shown][1] if k.name == "datetime" else None, COLLATION if k.text else None) for t, c, i, k in columns])
    if what == "schemata":
        return _df(engine, _fields("CATALOG_NAME SCHEMA_NAME SCHEMA_OWNER"), [("master", "dbo", "dbo")])
    if what == "catalogs":
        return _df(engine, _fields("CATALOG_NAME DESCRIPTION"), [("master", None)])
    if what == "types":
        return _df(engine, _fields("TYPE_NAME DATA_TYPE:int COLUMN_SIZE:int IS_NULLABLE:boolean"), [(n, t[3], t[0] or t[2], True) for n, t in TYPES.items()])
    if what:
        return _df(engine, _fields(_EMPTY_ROWSETS[what]))
    if called.startswith(("sp_", "xp_")):
        raise TsqlError(2812, f"Could not find stored procedure '{called}'.")
    return None
