"""English function words."""

# English function words.
ENGLISH = frozenset("""
a about above across after again against all almost alone along already also although always am among amount an and
another any anyhow anyone anything anywhere are around as at be became because become been before behind being below
beside besides between beyond both but by call can cannot could did do does doing done down due during each eight either
else elsewhere empty enough even ever every everyone everything everywhere except few for from front full further get
give go had has have he hence her here hers herself him himself his how however i if in indeed into is it its itself
just keep last latter least less made make many may me might mine more most mostly move much must my myself name neither
never next no nobody none nor not nothing now nowhere of off often on once one only onto or other others our ours out
over own per perhaps put rather really same see seem she should show side since so some such take than that the their
them then there these they this those through to too under until up upon us very was we well were what when where which
while who whole whom whose why will with within would yet you your
""".split())


def english() -> frozenset[str]:
    """The list of the spaCy library where it is installed, else the shorter one above; detectors take another as an option."""
    try:
        from spacy.lang.en.stop_words import STOP_WORDS
    except ImportError:
        return ENGLISH
    return frozenset(STOP_WORDS)
