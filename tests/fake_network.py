"""Answers from files, so that workers see what a test has put there; each question is a file, too."""

import hashlib
import os
import uuid


def put(folder, address, body):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{hashlib.md5(address.encode()).hexdigest()}", "w", encoding="utf-8") as f:
        f.write(body)


def answers(folder):
    """address -> body or None."""

    def get(address):
        os.makedirs(f"{folder}/asked", exist_ok=True)
        with open(f"{folder}/asked/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(address)
        try:
            with open(f"{folder}/{hashlib.md5(address.encode()).hexdigest()}", encoding="utf-8") as f:
                return f.read()
        except OSError:
            return None

    return get


def asked(folder):
    if not os.path.isdir(f"{folder}/asked"):
        return []
    return sorted(open(f"{folder}/asked/{x}", encoding="utf-8").read() for x in os.listdir(f"{folder}/asked"))
