"""Core."""
import os
from . import util
from .util import helper as h

API_TOKEN = "not-a-real-token-value"


class Widget(Base):
    def turn(self):
        return os.name


async def fetch():
    return h()


@app.get("/items")
def items():
    return util
