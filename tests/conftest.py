import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helixframe.session import get_session  # noqa: E402

CHR_T = "AACGTTNGCATGCC"  # FIXTURES.md worked-example contig (length 14)


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def chrt_fasta(tmp_path_factory):
    """chrT as a multi-line FASTA, plus a second contig."""
    d = tmp_path_factory.mktemp("fasta")
    p = d / "genome.fa"
    p.write_text(">chrT test contig\nAACGT\nTNGCA\nTGCC\n>chrU\nacgtn\nACG\n")
    return str(p)
