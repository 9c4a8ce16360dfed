"""A small log of commits: an authentication package with the call structure that the golden numbers are for."""

from __future__ import annotations

MODELS = '''
_store = {}


def create_user(username, password):
    """Keep a new account."""
    if not username:
        raise ValueError("no name")
    _store[username] = password
    return True


def get_user(username):
    return _store.get(username)


def delete_user(username):
    return _store.pop(username, None) is not None


def list_users():
    return list(_store)


def user_exists(username):
    return username in _store
'''

SERVICE = '''from auth.models import create_user, delete_user, get_user, user_exists


class AuthError(Exception):
    pass


class ValidationError(AuthError):
    pass


class AuthenticationError(AuthError):
    pass


def validate_username(username):
    if len(username) < 3:
        raise ValidationError("short")


def signup(username, password):
    validate_username(username)
    if user_exists(username):
        return {"ok": False}
    return {"ok": create_user(username, password)}


def login(username, password):
    if get_user(username) != password:
        raise AuthenticationError("wrong")
    return {"ok": True}


def logout(username):
    return {"ok": user_exists(username)}


def delete_account(username, password):
    login(username, password)
    return {"ok": delete_user(username)}
'''

V1, V2 = "623241a" + "0" * 33, "eef5695" + "0" * 33
EARLY, LATE = "2026-06-24T10:00:00+00:00", "2026-06-26T10:00:00+00:00"


def commit(seq: int, sha: str, files: dict[str, str | None], msg: str = "Change\n\nA note.\n More. ", timestamp: str = EARLY) -> list[tuple]:
    return [(seq, sha, "a", msg, timestamp, k, path, source) for k, (path, source) in enumerate(files.items())] or [(seq, sha, "a", msg, timestamp, None, None, None)]


FULL = {"auth/__init__.py": "\n", "auth/models.py": MODELS, "auth/service.py": SERVICE}
ONE = commit(0, V1, FULL)
TWO = ONE + commit(1, V2, {k: v.replace("return", "return  ") for k, v in FULL.items()}, "Second", LATE)
