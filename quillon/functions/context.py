"""Functions that tell of the session and server, and the @@ variables: literals of the moment."""

from __future__ import annotations

import zlib

from .convert import literal, null
from .kinds import BINARY, INT, TEXT, Ex, quoted

VERSION = "Microsoft SQL Server 2022 (RTM) - 16.0.1000.6 compatible analytics engine"
COLLATION = "SQL_Latin1_General_CP1_CI_AS"
#: What SERVERPROPERTY and its relatives answer.
SERVER = {
    "BUILDCLRVERSION": "v4.0.30319", "COLLATION": COLLATION, "COLLATIONID": 872468488, "COMPARISONSTYLE": 196609, "COMPUTERNAMEPHYSICALNETBIOS": "localhost", "EDITION": "Developer Edition (64-bit)",
    "EDITIONID": -2117995310, "ENGINEEDITION": 3, "FILESTREAMCONFIGUREDLEVEL": 0, "FILESTREAMEFFECTIVELEVEL": 0, "FILESTREAMSHARENAME": None, "HADRMANAGERSTATUS": 2, "INSTANCEDEFAULTDATAPATH": None,
    "INSTANCEDEFAULTLOGPATH": None, "INSTANCENAME": None, "ISADVANCEDANALYTICSINSTALLED": 0, "ISBIGDATACLUSTER": 0, "ISCLUSTERED": 0, "ISEXTERNALAUTHENTICATIONONLY": 0, "ISFULLTEXTINSTALLED": 0,
    "ISHADRENABLED": 0, "ISINTEGRATEDSECURITYONLY": 0, "ISLOCALDB": 0, "ISPOLYBASEINSTALLED": 0, "ISSERVERSUSPENDEDFORSNAPSHOTBACKUP": 0, "ISSINGLEUSER": 0, "ISTEMPDBMETADATAMEMORYOPTIMIZED": 0,
    "ISXTPSUPPORTED": 0, "LCID": 1033, "LICENSETYPE": "DISABLED", "MACHINENAME": "localhost", "NUMLICENSES": None, "PATHSEPARATOR": "/", "PROCESSID": 1, "PRODUCTBUILD": "1000", "PRODUCTLEVEL": "RTM",
    "PRODUCTMAJORVERSION": "16", "PRODUCTMINORVERSION": "0", "PRODUCTVERSION": "16.0.1000.6", "SERVERNAME": "localhost", "SQLCHARSET": 1, "SQLSORTORDER": 52,
}
DATABASE = {"COLLATION": COLLATION, "STATUS": "ONLINE", "UPDATEABILITY": "READ_ONLY", "USERACCESS": "MULTI_USER", "RECOVERY": "SIMPLE", "VERSION": 957, "ISAUTOCLOSE": 0, "ISAUTOSHRINK": 0}
CONNECTION = {"NET_TRANSPORT": "TCP", "PROTOCOL_TYPE": "TSQL", "AUTH_SCHEME": "SQL", "LOCAL_NET_ADDRESS": "127.0.0.1", "LOCAL_TCP_PORT": 1433, "CLIENT_NET_ADDRESS": "127.0.0.1", "PHYSICAL_NET_TRANSPORT": "TCP"}
COLLATION_PROPERTIES = {"CODEPAGE": 1252, "LCID": 1033, "COMPARISONSTYLE": 196609, "VERSION": 0}


def object_id(name: str) -> int:
    """A stable number for a table's name."""
    return (zlib.crc32(name.lower().encode()) & 0x7FFFFFFF) or 1


def _constant(value, kind=None):
    return lambda session, args: literal(value) if value is not None else null(kind or INT)


def _of_session(get):
    return lambda session, args: literal(get(session)) if get(session) is not None else null(TEXT)


def _error(key: str, kind):
    def answer(session, args: list[Ex]) -> Ex:
        value = session.error.get(key) if session.error else None
        return null(kind) if value is None else literal(value)

    return answer


def _property(table: dict, at: int):
    def answer(session, args: list[Ex]) -> Ex:
        value = table.get(str(args[at].value).upper()) if len(args) > at and args[at].constant else None
        return null(TEXT) if value is None else literal(value)

    return answer


def _last(value) -> str:
    return str(value).replace("[", "").replace("]", "").split(".")[-1]


def _object_id(session, args: list[Ex]) -> Ex:
    if args and not args[0].constant:
        from .scalar import plain  # of a column: the names that are known, as a CASE

        last = f"lower(regexp_replace(substring_index({plain(args[0])}, '.', -1), {quoted(r'[\[\]]')}, ''))"
        return Ex(f"CASE {last} " + " ".join(f"WHEN {quoted(n.lower())} THEN {object_id(n)}" for n in session.names()) + " END", INT) if session.names() else null(INT)
    name = _last(args[0].value) if args and args[0].value is not None else ""
    return literal(object_id(name)) if session.knows(name) else null(INT)


def _object_property(session, args: list[Ex]) -> Ex:
    known = {object_id(n) for n in session.names()}
    if len(args) < 2 or args[0].value not in known:
        return null(INT)
    return literal({"ISTABLE": 1, "ISUSERTABLE": 1, "OWNERID": 1}.get(str(args[1].value).upper(), 0))


#: Functions by name: (session, arguments) to an expression.
CONTEXT = {
    **dict.fromkeys(("SUSER_SNAME", "SUSER_NAME", "ORIGINAL_LOGIN", "SYSTEM_USER"), _of_session(lambda s: s.login)), **dict.fromkeys(("USER_NAME", "USER", "CURRENT_USER", "SESSION_USER", "SCHEMA_NAME"), _constant("dbo")),
    "DB_NAME": _of_session(lambda s: s.database), "DB_ID": _constant(1), "HOST_NAME": _of_session(lambda s: s.host), "APP_NAME": _of_session(lambda s: s.app), "HAS_DBACCESS": _constant(1),
    "OBJECT_ID": _object_id, "IS_SRVROLEMEMBER": _constant(0), "IS_MEMBER": _constant(0), "HAS_PERMS_BY_NAME": _constant(0), "PERMISSIONS": _constant(0),
    "ERROR_NUMBER": _error("number", INT), "ERROR_MESSAGE": _error("message", TEXT), "ERROR_SEVERITY": _error("severity", INT), "ERROR_STATE": _error("state", INT),
    "ERROR_LINE": _constant(None), "ERROR_PROCEDURE": _constant(None, TEXT), **dict.fromkeys(("GETDATE", "CURRENT_TIMESTAMP", "SYSDATETIME", "GETUTCDATE", "SYSUTCDATETIME"), _of_session(lambda s: s.now)),
    "SID_BINARY": _constant(None, BINARY), "SUSER_SID": _constant(None, BINARY), "SUSER_ID": _constant(None), "USER_ID": _constant(1), "FN_SYSPOLICY_IS_AUTOMATION_ENABLED": _constant(0), "FN_DIAGRAMOBJECTS": _constant(0),
    "COLLATIONPROPERTY": _property(COLLATION_PROPERTIES, 1), "DATABASEPROPERTYEX": _property(DATABASE, 1), "OBJECTPROPERTY": _object_property, "OBJECTPROPERTYEX": _object_property,
    "SERVERPROPERTY": _property(SERVER, 0), "CONNECTIONPROPERTY": _property(CONNECTION, 0),
}

VARIABLES = {
    "@@VERSION": lambda s: VERSION, "@@SERVERNAME": lambda s: "localhost", "@@SPID": lambda s: s.spid, "@@LANGUAGE": lambda s: "us_english", "@@MAX_PRECISION": lambda s: 38,
    "@@MICROSOFTVERSION": lambda s: 268436456, "@@NESTLEVEL": lambda s: s.nest_level, "@@ROWCOUNT": lambda s: s.row_count, "@@TRANCOUNT": lambda s: s.tran_count, "@@OPTIONS": lambda s: 5432, "@@ERROR": lambda s: s.last_error,
    "@@FETCH_STATUS": lambda s: 0, "@@IDENTITY": lambda s: None,
}
