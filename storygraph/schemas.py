"""Schemas of the story documents, and the fixed vocabularies of the graph."""

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# The entity types in the order of frequency tables, and what extra fields each type has.
ENTITY_TYPES = ("character", "location", "object", "organisation", "document", "case")
TYPE_FIELDS = {
    "object": ("source",),
    "case": ("client", "crime_type", "outcome", "primary_location"),
    "document": ("document_type", "from", "to", "content_summary"),
    "organisation": ("org_type",),
}
# Each relation with the kinds of its ends, and the kinds in the order in which a later one wins.
RELATIONS = {
    "PARTICIPATED_IN": ("entity", "event"),
    "PERFORMED": ("entity", "event"),
    "SPOKE_IN": ("entity", "event"),
    "TOLD_TO": ("event", "entity"),
    "MENTIONED_IN": ("entity", "section"),
    "IS_INSIDE": ("entity", "entity"),
    "LOCATED_AT": ("entity", "entity"),
    "OWNS": ("entity", "entity"),
    "CLUE_FOR": ("entity", "entity"),
    "MEMBER_OF": ("entity", "entity"),
}
STATES = ("IS_INSIDE", "LOCATED_AT", "OWNS")
KINDS = ("story", "section", "lexical", "entity", "event")

META = _struct(slug=S, name=S, sourceFile=S)
SECTION = _struct(id=S, index=I, title=S, wordCount=I)
LEXICAL_NODE = _struct(id=S, section=S, position=I, text=S, entities=L)
LEXICAL = _struct(granularity=S, sections=T.ArrayType(SECTION), nodes=T.ArrayType(LEXICAL_NODE))
ENTITY = T.StructType(
    [T.StructField(n, S) for n in ("id", "type", "label", "description", "firstSection", "source", "client", "crime_type", "outcome", "primary_location", "document_type", "from", "to", "content_summary", "org_type")]
)
SPEECH = _struct(speaker=S, recipients=L, content=S)
EVENT = _struct(id=S, label=S, section=S, source_nodes=L, participants=L, performs=L, communicates=SPEECH)
STATE_EDGE = T.StructType([*[T.StructField(n, S) for n in ("id", "from", "to", "type", "valid_from", "valid_until")], T.StructField("caused_by", L)])
MENTION = _struct(entity=S, section=S, mention_count=I, sentence_ids=L)
CLUE = _struct(object=S, case=S, discovered_by=S, discovered_in_section=S, significance=S, source_nodes=L)
MEMBER = _struct(character=S, organisation=S, valid_from=S, valid_until=S)
GRAPH = _struct(
    entities=T.ArrayType(ENTITY), events=T.ArrayType(EVENT), stateEdges=T.ArrayType(STATE_EDGE), mentions=T.ArrayType(MENTION), clues=T.ArrayType(CLUE), memberOf=T.ArrayType(MEMBER)
)
# The answer of an extraction: the same things, before they are numbered and checked.
EXTRACTION = T.StructType(
    [
        T.StructField("newEntities", T.ArrayType(ENTITY)),
        T.StructField("events", T.ArrayType(_struct(id=S, label=S, source_nodes=L, participants=L, performs=L, communicates=SPEECH))),
        T.StructField("stateChanges", T.ArrayType(T.StructType([T.StructField(n, S) for n in ("from", "to", "type", "caused_by_event")]))),
        T.StructField("mentions", T.ArrayType(_struct(entity=S, sentence_ids=L))),
        T.StructField("clues", T.ArrayType(_struct(object=S, case=S, discovered_by=S, significance=S, source_nodes=L))),
        T.StructField("memberOf", T.ArrayType(MEMBER)),
    ]
)
EXAMPLES = T.ArrayType(_struct(id=S, character=S, section=S, question=S, expectedTheme=S))
