"""Fixed values of the reaction table.  Each must be exactly what the table's curators wrote."""

from __future__ import annotations

# Substrate names and their structures.
SUBSTRATES = {
    "(2E,6E)-FPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "(2E,6E,10E)-GGPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "GGPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "(+)-copalyl diphosphate": "[H][C@@]12CCC(=C)[C@H](CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O)[C@@]1(C)CCCC2(C)C",
    "(2E,6E)-FPP; isopentenyl PP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "(2E)-GPP; isopentenyl PP": "CC(C)=CCC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "dimethylallyl PP; isopentenyl PP": "CC(=CCOP(=O)([O-])OP(=O)([O-])[O-])C.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "(2E)-GPP": "CC(C)=CCC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "ent-copalyl diphosphate": "[C@@H]1(CC/C(/C)=C/COP(OP(=O)([O-])[O-])(=O)[O-])C(=C)CC[C@]2([C@@]1(C)CCCC2(C)C)[H]",
    "(2Z,6E)-FPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C/COP([O-])(=O)OP([O-])([O-])=O",
    "(S)-2,3-epoxysqualene": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C=C(/C)CC\\C=C(/C)CC[C@@H]1OC1(C)C",
    "peregrinol PP": "[C@@]1(CC/C(/C)=C/COP(OP(=O)([O-])[O-])(=O)[O-])([C@@H](CC[C@@]2([C@]1(C)CCCC2(C)C)[H])C)O",
    "copal-8-ol diphosphate(3−)": "[H][C@@]12CC[C@@](C)(O)[C@H](CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O)[C@@]1(C)CCCC2(C)C",
    "NPP": "CC(=CCC/C(=C\\COP(=O)(O)OP(=O)(O)O)/C)C",
    "9α-copalyl PP": "[H][C@@]12CCC(=C)[C@@H](CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O)[C@@]1(C)CCCC2(C)C",
    "(2Z,6Z)-FPP": "CC(C)=CCC\\C(C)=C/CC\\C(C)=C/COP([O-])(=O)OP([O-])([O-])=O",
    "ent-copal-8-ol diphosphate(3−)": "[C@@H]1(CC/C(/C)=C/COP(OP(=O)([O-])[O-])(=O)[O-])[C@](CC[C@]2([C@@]1(C)CCCC2(C)C)[H])(O)C",
    "9α-copalyl diphosphate": "[H][C@@]12CCC(=C)[C@@H](CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O)[C@@]1(C)CCCC2(C)C",
    "(2E,6E,10E,14E)-GFPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "(R)-tetraprenyl-β-curcumene": "C[C@H](CC\\C=C(/C)CC\\C=C(/C)CC\\C=C(/C)CC\\C=C(/C)CCC=C(C)C)C1=CCC(C)=CC1",
    "(E)-2-MeGPP": "CC(C)=CCC\\C(C)=C(/C)COP([O-])(=O)OP([O-])([O-])=O",
    "dimethylallyl PP; 4 isopentenyl PP": "CC(=C)CCOP(=O)(O)OP(=O)(O)O.CC(=C)CCOP(=O)(O)OP(=O)(O)O.CC(=C)CCOP(=O)(O)OP(=O)(O)O.CC(=C)CCOP(=O)(O)OP(=O)(O)O.CC(=CCOP(=O)([O-])OP(=O)([O-])[O-])C",
    "(3S,22S)-2,3:22,23-diepoxy-2,3,22,23-tetrahydrosqualene": "C(C/C=C(/CC/C=C(/CC[C@H]1C(O1)(C)C)\\C)\\C)/C=C(/CC/C=C(/CC[C@H]2C(O2)(C)C)\\C)\\C",
    "pre-α-onocerin": "C1C[C@@H](C([C@]2([C@]1([C@H](C(CC2)=C)CC/C=C(/CC/C=C(/CC[C@H]3C(O3)(C)C)\\C)\\C)C)[H])(C)C)O",
    "dimethylallyl PP": "CC(=CCOP(=O)([O-])OP(=O)([O-])[O-])C",
    "(R,R)-chrysanthemyl diphosphate": "CC(C)=C[C@@H]1[C@@H](COP([O-])(=O)OP([O-])([O-])=O)C1(C)C",
    "(R)-lavandulyl diphosphate(3−)": "C(=CC[C@@H](COP([O-])(=O)OP(=O)([O-])[O-])C(C)=C)(C)C",
    "PPP": "CC(C)CCC[C@@H](C)CCC[C@@H](C)CCC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "HexPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "HepPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "presqualene PP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\[C@H]1[C@H](COP([O-])(=O)OP([O-])([O-])=O)[C@@]1(C)CC\\C=C(/C)CCC=C(C)C",
    "isopentenyl PP; (2E,6E,10E)-GGPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "isopentenyl PP; (2E,6E)-FPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "isopentenyl PP; (2E)-GPP": "CC(C)=CCC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "prephytoene PP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\C1C(COP(O)(=O)OP(O)(O)=O)C1(C)CC\\C=C(/C)CC\\C=C(/C)CCC=C(C)C",
    "(2E,6E,10E)-GGPP; isopentenyl PP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "Unknown": "Unknown",
    "isopentenyl PP": "CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "γ-carotene": "CC1=C(C(CCC1)(C)C)C=CC(=CC=CC(=CC=CC=C(C)C=CC=C(C)C=CC=C(C)CCC=C(C)C)C)C",
    "CDP": "CC(=CCOP(=O)(O)OP(=O)(O)O)CCC1C(=C)CCC2C1(CCCC2(C)C)C",
    "(2E,6E)-FPP + IPP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP([O-])(=O)OP([O-])([O-])=O",
    "(2E)-GPP + IPP": "CC(C)=CCC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP([O-])(=O)OP([O-])([O-])=O",
    "dimethylallyl PP+ IPP": "CC(=CCOP(=O)([O-])OP(=O)([O-])[O-])C.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "squalene": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\CC\\C=C(/C)CC\\C=C(/C)CCC=C(C)C",
    "(13E)-labda-7,13-dien-15-yl PP": "[C@H]1(CC/C(/C)=C/COP(OP(=O)(O)O)(=O)O)C(C)=CC[C@@]2([C@]1(C)CCCC2(C)C)[H]",
    "all-trans-lycopene": "CC(C)=CCC\\C(C)=C\\C=C\\C(C)=C\\C=C\\C(C)=C\\C=C\\C=C(C)\\C=C\\C=C(C)\\C=C\\C=C(/C)CCC=C(C)C",
    "dimethylallyl PP + isopentenyl PP": "CC(=CCOP(=O)([O-])OP(=O)([O-])[O-])C.CC(=C)CCOP(=O)(O)OP(=O)(O)O",
    "(2E,6E)-FPP;  isopentenyl PP": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O.CC(=C)CCOP([O-])(=O)OP([O-])([O-])=O",
    "(2E,6E)-FPP ": "CC(C)=CCC\\C(C)=C\\CC\\C(C)=C\\COP([O-])(=O)OP([O-])([O-])=O",
    "syn-CPP": "C/C(=C\\COP(=O)(O)OP(=O)(O)O)/CC[C@@H]1C(=C)CC[C@H]2[C@]1(CCCC2(C)C)C",
    "CPP": "C/C(=C\\COP(=O)(O)OP(=O)(O)O)/CC[C@@H]1C(=C)CC[C@H]2[C@]1(CCCC2(C)C)C",
    "syn-CDP": "CC(=CCOP(=O)(O)OP(=O)(O)O)CCC1C(=C)CCC2C1(CCCC2(C)C)C",
    "(2Z,6Z,10Z)-NNPP": "CC(C)=CCCC(/C)=C/CCC(/C)=C/CCC(/C)=C/COP([O-])(OP([O-])([O-])=O)=O",
}

# Fixed values: (type, substrate, substrate of two molecules) of reactions that join two molecules.
MULTI_MOLECULE = [
    ("tetra", "CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O", "CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O.CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"),
    ("tetra", "CC(C)CCCC(C)CCCC(C)CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O", "CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O.CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"),
    ("tetra-int", "CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O", "CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O.CC(C)=CCCC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"),
    ("tri", "CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O", "CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O.CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"),
    ("tri-int", "CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O", "CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O.CC(C)=CCCC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"),
]

# Kingdoms and the category they belong to.
KINGDOMS = {
    "Animalia": "Animals",
    "Coral": "Animals",
    "Insecta": "Animals",
    "Animalia_(Marine_Sponge)": "Animals",
    "Human": "Animals",
    "Human_(Animalia)": "Animals",
    "Slime mold": "Protists",
    "Red_algae": "Plants",
    "Plantae": "Plants",
}

# Parts of a cell comment that put its row on the blacklist.
BLACKLIST_COMMENTS = (
    "not characterized",
    "not characetrized",
    "could not verify",
    "not find",
    "ques-tion mark also remains over the direct products",
    "wrongly annotated",
    "full length protein was not active",
)

# The file and residues of each domain's template.
TEMPLATES = {
    "alpha": ("1ps1", None),
    "beta": ("5eat", "37-57+64-97+104-117+123-129+138-156+162-195+203-213+223-239"),
    "gamma": ("3p5r", "138-151+157-171+185-222+233-248+258-275+281-304+313-339"),
    "delta": ("P48449", "73-87+385-399+401-403+405-421+454-470+480-493+531-547+553-570+585-599+610-622+633-638+649-662+667-680+707-722+727-729"),
    "epsilon": ("P48449", "103-115+123-134+151-164+171-183+191-200+213-217+226-228+231-246+254-263+268-270+273-277+291-306+309-330+337-351+356-371+376-378+510-515"),
}
