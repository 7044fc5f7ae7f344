"""HTML that shows a model in a browser (O-69)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The diagram viewer that the browser fetches.
VIEWER = "https://unpkg.com/bpmn-js@17/dist/bpmn-navigated-viewer.production.min.js"
PAGE = (
    '<!doctype html><html><head><meta charset="utf-8"><script src="{viewer}"></script></head><body style="margin:0">'
    '<div id="view" style="height:{height}px"></div><script>const bytes=Uint8Array.from(atob("'
)
TAIL = (
    '"),c=>c.charCodeAt(0));const view=new BpmnJS({container:"#view"});'
    'view.importXML(new TextDecoder().decode(bytes)).then(()=>view.get("canvas").zoom("fit-viewport"));</script></body></html>'
)


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def viewer_html(xml: Column, height: int = 500) -> Column:
    """A page that draws the model. The XML goes in as base64, so that nothing in it can end the script."""
    coded = one_line(F.base64(F.encode(xml, "UTF-8")))
    return F.concat(F.lit(PAGE.format(viewer=VIEWER, height=int(height))), coded, F.lit(TAIL))


def viewer_iframe(xml: Column, height: int = 500) -> Column:
    """An iframe with the page as a data URI."""
    coded = one_line(F.base64(F.encode(viewer_html(xml, height), "UTF-8")))
    return F.concat(F.lit('<iframe src="data:text/html;base64,'), coded, F.lit(f'" width="100%" height="{int(height)}" style="border:0"></iframe>'))
