"""Parameters shared by the registered queries and their oracle SQL."""

from ..operators.splits import DEFAULT_TEST_CHROMS

# Window, flank and training jitter of the splice-site track.
WINDOW = 300          # bases per window
FLANK = 300           # flanking bases each side
SHIFT = 23            # training jitter
FAR_SHIFT = 700       # jitter of more than two tiles, for the far label query
NUM_VAL_GENES = 200   # validation draw (the 1000 default exceeds the sf0.001 pool)
SEED = 0
EPOCH = 0
CHUNK = 4096          # genome chunk size for the registered queries
HALO = 1024           # bases of the next chunk stored with each chunk
KMER_K, KMER_LEFT, KMER_RIGHT, KMER_STEP = 3, 1, 1, 1
BATCH_SIZE = 32
SAMPLE_FRACTION = 0.2
TEST_CHROMS = DEFAULT_TEST_CHROMS
N_MODELS = 21         # pred3 packs 21 three-class models behind one special value
CENTER_FLANK, CENTER_WINDOW = 21, 21
KL_WEIGHT = 1.0
TRAILING_N = 3        # trailing-mean width of the short query; the other has the default of 100
RANGES = 13           # of the ranking queries that fix their number
ORDER_BATCH = 10      # batch size of the query in file order
PIECE = 1000          # bases of a piece of a record
